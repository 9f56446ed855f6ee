"""What operations mean together: classes, severities, counts, breakdowns, filters, searches and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import a1, letters

GRID = (
    "SheetAdded", "SheetRemoved", "SheetRenamed", "RowAdded", "RowRemoved", "RowReplaced", "DuplicateKeyCluster", "ColumnAdded", "ColumnRemoved",
    "BlockMovedRows", "BlockMovedColumns", "BlockMovedRect", "RectReplaced", "CellEdited",
)
OBJECTS = tuple(f"{k}{c}" for k in ("NamedRange", "Chart", "VbaModule") for c in ("Added", "Removed", "Changed"))
QUERIES = ("QueryAdded", "QueryRemoved", "QueryRenamed", "QueryDefinitionChanged", "QueryMetadataChanged")
MODEL = (
    "TableAdded", "TableRemoved", "ModelColumnAdded", "ModelColumnRemoved", "ModelColumnTypeChanged", "ModelColumnPropertyChanged",
    "CalculatedColumnDefinitionChanged", "RelationshipAdded", "RelationshipRemoved", "RelationshipPropertyChanged", "MeasureAdded", "MeasureRemoved",
    "MeasureDefinitionChanged",
)
_HIGH = ("DuplicateKeyCluster", "QueryAdded", "QueryRemoved", "MeasureAdded", "MeasureRemoved", "TableAdded", "TableRemoved", "SheetAdded", "SheetRemoved")
_JUDGED = ("QueryDefinitionChanged", "MeasureDefinitionChanged", "CalculatedColumnDefinitionChanged")


def grid_ops(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("kind").isin(*GRID))


def query_ops(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("kind").isin(*QUERIES))


def category(kind: Column) -> Column:
    return F.when(kind.isin(*QUERIES), "PowerQuery").when(kind.isin(*MODEL), "Model").when(kind.isin(*OBJECTS), "Objects").when(kind.isin(*GRID), "Grid").otherwise("Other")


def change_class(kind: Column, field: Column | None = None) -> Column:
    """added, removed, moved or modified; loading a query to a sheet counts as added."""
    out = F.when(kind.endswith("Added"), "added").when(kind.endswith("Removed"), "removed").when(kind.startswith("BlockMoved"), "moved")
    if field is not None:
        out = out.when((kind == "QueryMetadataChanged") & (field == "LoadToSheet"), "added")
    return out.otherwise("modified")


def severity(kind: Column, change_kind: Column | None = None, formula_diff: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    how, formula = none if change_kind is None else change_kind, none if formula_diff is None else formula_diff
    judged = F.when(how == "Semantic", "high").when(how == "FormattingOnly", "low").otherwise("medium")
    cell = F.when(formula == "SemanticChange", "high").when(formula == "FormattingOnly", "low").otherwise("medium")
    return F.when(kind.isin(*_HIGH), "high").when(kind.isin(*_JUDGED), judged).when(kind == "CellEdited", cell).when(kind.isin("SheetRenamed", "QueryRenamed"), "low").otherwise("medium")


def without_noise(ops: DataFrame, queries: bool = False, measures: bool = False, formulas: bool = False) -> DataFrame:
    """Operations without changes of formatting alone, as far as they are hidden."""
    k, how = F.col("kind"), F.coalesce(F.col("change_kind"), F.lit("")) == "FormattingOnly"
    hidden = F.lit(False)
    if queries:
        hidden |= (k == "QueryDefinitionChanged") & how
    if measures:
        hidden |= k.isin("MeasureDefinitionChanged", "CalculatedColumnDefinitionChanged") & how
    if formulas:
        hidden |= (k == "CellEdited") & (F.coalesce("formula_diff", F.lit("")) == "FormattingOnly")
    return ops.where(~hidden)


def move_id(kind: Column) -> Column:
    """The name of a move, from its source, size and target."""
    n, m = F.col("row_end") - F.col("row") + 1, F.col("col_end") - F.col("col") + 1
    return (
        F.when(kind == "BlockMovedRows", F.format_string("r:%d+%d->%d", "row", n, "dst_row"))
        .when(kind == "BlockMovedColumns", F.format_string("c:%d+%d->%d", "col", m, "dst_col"))
        .when(kind == "BlockMovedRect", F.format_string("rect:%d,%d+%dx%d->%d,%d", "row", "col", n, m, "dst_row", "dst_col"))
    )


def classified(ops: DataFrame, collapse_moves: bool = False) -> DataFrame:
    """Operations with category, severity, change and move_id; equal moves of a sheet may count once."""
    k = F.col("kind")
    out = ops.withColumns({
        "category": category(k), "severity": severity(k, F.col("change_kind"), F.col("formula_diff")), "change": change_class(k, F.col("field")), "move_id": move_id(k),
    })
    if not collapse_moves:
        return out
    moves = out.where("move_id is not null").dropDuplicates(["pair_id", "sheet", "kind", "move_id"])
    return out.where("move_id is null").unionByName(moves)


_CHANGES, _SEVERITIES = ("added", "removed", "modified", "moved"), ("high", "medium", "low")


def _counted(df: DataFrame, *by: str) -> DataFrame:
    cols = [F.count_if(F.col("change") == c).alias(c) for c in _CHANGES] + [F.count_if(F.col("severity") == s).alias(s) for s in _SEVERITIES]
    return df.groupBy(*by).agg(F.count("*").alias("op_count"), *cols)


def change_counts(ops: DataFrame) -> DataFrame:
    """Operations of each pair in all, by change and by severity."""
    return _counted(classified(ops), "pair_id")


def by_sheet(ops: DataFrame) -> DataFrame:
    """The same for each sheet; sheet_rank orders sheets by high severity, operations and name."""
    from pyspark.sql import Window

    found = _counted(classified(grid_ops(ops)), "pair_id", "sheet")
    order = Window.partitionBy("pair_id").orderBy(F.col("high").desc(), F.col("op_count").desc(), F.lower("sheet"))
    return found.withColumn("sheet_rank", F.row_number().over(order))


def by_category(ops: DataFrame) -> DataFrame:
    """Category by severity, with subtotals and the total (null)."""
    return classified(ops).rollup("category", "severity").agg(F.count("*").alias("n"))


def store_analysis(ops: DataFrame) -> DataFrame:
    """Counts by everything a stored operation is grouped by: kind, sheet, move, kind of change, formula change, field."""
    return classified(ops).groupBy("pair_id", "kind", "sheet", "move_id", "change_kind", "formula_diff", "field").agg(F.count("*").alias("n"))


def navigator(ops: DataFrame) -> DataFrame:
    """Sheets with their change counts and a rank: modified first, then added, removed, others."""
    found = _counted(classified(grid_ops(ops)), "pair_id", "sheet")
    added = ops.where("kind in ('SheetAdded', 'SheetRemoved')").select("pair_id", "sheet", "kind")
    rank = F.when(F.col("kind") == "SheetAdded", 1).when(F.col("kind") == "SheetRemoved", 2).when(F.col("op_count") > 0, 0).otherwise(3)
    return found.join(added, ["pair_id", "sheet"], "left").withColumn("rank", rank).drop("kind")


def cell_volume(sheets: DataFrame) -> DataFrame:
    """Cells to compare, an upper estimate: for each sheet the larger side. sheets(pair_id, side, sheet, n_cells)."""
    larger = sheets.groupBy("pair_id", F.lower("sheet").alias("sheet")).agg(F.max("n_cells").alias("n"))
    return larger.groupBy("pair_id").agg(F.sum("n").alias("cells"))


def touching(ops: DataFrame, row_from: int, row_to: int, col_from: int | None = None, col_to: int | None = None) -> DataFrame:
    """Operations that overlap a window of rows, and of columns if given; those without rows or columns always do."""

    def within(start: str, end: str, a: int, b: int) -> Column:
        return F.col(start).isNull() | ((F.col(start) <= b) & (F.coalesce(end, start) >= a))

    out = ops.where(within("row", "row_end", row_from, row_to))
    return out if col_from is None else out.where(within("col", "col_end", col_from, col_to))


def search(df: DataFrame, columns: list[str], words: list[str], limit: int | None = None) -> DataFrame:
    """Rows of which a column holds one of the words, in any case."""
    text = F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in columns]))
    hit = F.lit(False)
    for w in words:
        hit |= text.contains(w.lower())
    out = df.where(hit)
    return out if limit is None else out.limit(limit)


def token_search(df: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    """(key, token, n): words of a text that start with a prefix."""
    each = df.select(key, F.explode(F.split(F.lower(F.col(text)), "[^a-z]+")).alias("token"))
    return each.where(F.col("token").startswith(prefix.lower())).groupBy(key, "token").agg(F.count("*").alias("n"))


def rendered(cell: Column) -> Column:
    """A cell as text: formulas with their sign, whole numbers without a point, errors and truth values as sheets show them."""
    n = cell["num"]
    number = F.when((n == F.floor(n)) & (F.abs(n) < 1e15), F.floor(n).cast("string")).otherwise(n.cast("string"))
    value = F.when(cell["vkind"] == "number", number).when(cell["vkind"] == "bool", F.when(cell["flag"], "TRUE").otherwise("FALSE")).when(cell["vkind"] == "blank", "").otherwise(cell["txt"])
    return F.coalesce(value, F.concat(F.lit("="), cell["formula"]))


def cell_edits(ops: DataFrame) -> DataFrame:
    """(sheet, coords, value_file1, value_file2) of edits whose values differ."""
    edits = ops.where("kind = 'CellEdited'").select("pair_id", "sheet", a1(F.col("row"), F.col("col")).alias("coords"), rendered(F.col("from")).alias("value_file1"), rendered(F.col("to")).alias("value_file2"))
    return edits.where("not (value_file1 <=> value_file2)")


def location(kind: Column) -> Column:
    """Where an operation is, as people write it."""
    rows = F.format_string("%d:%d", F.col("row") + 1, F.coalesce("row_end", "row") + 1)
    cols = F.concat(letters(F.col("col")), F.lit(":"), letters(F.coalesce("col_end", "col")))
    box = F.concat(a1(F.col("row"), F.col("col")), F.when(F.col("row_end").isNotNull() & ((F.col("row_end") != F.col("row")) | (F.col("col_end") != F.col("col"))), F.concat(F.lit(":"), a1(F.col("row_end"), F.col("col_end")))).otherwise(""))
    return F.when(F.col("row").isNotNull() & F.col("col").isNotNull(), box).when(F.col("row").isNotNull(), rows).when(F.col("col").isNotNull(), cols)
