"""Diffs for callers: files, folders, tables and projects in, operations and reports out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .config import DiffConfig
from .functions.exprs import letters
from .operators import analysis, keyed, objects, project, views
from .plans import database, workbook
from .schema import ORDER, numbered, ops
from .sources import mashup
from .sources import project as folders
from .sources import workbook as books
from .store import Store


class DiffError(ValueError):
    """What a caller can mend; code is stable."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


@dataclass
class DiffResult:
    """Operations and warnings of one or many pairs of versions. Complete means: without warnings."""

    ops: DataFrame
    warnings: DataFrame
    old: str = ""
    new: str = ""
    parts: dict = field(default_factory=dict)

    def complete(self) -> bool:
        return self.warnings.isEmpty()

    def numbered(self) -> DataFrame:
        return numbered(self.ops)

    def summary(self) -> DataFrame:
        return analysis.change_counts(self.ops)

    def outcome(self) -> dict:
        """Counts, sheets and warnings, one small dictionary."""
        n = self.summary().drop("pair_id").groupBy().sum().first()
        counts = {k[4:-1]: v or 0 for k, v in n.asDict().items()}
        sheets = [r.asDict() for r in analysis.by_sheet(self.ops).orderBy("pair_id", "sheet_rank").limit(10_000).collect()]
        told = [r[0] for r in self.warnings.select("warning").distinct().orderBy("warning").limit(10_000).collect()]
        return {"old": self.old, "new": self.new, "complete": not told, "warnings": told, "counts": counts, "sheets": sheets}

    def text(self, quiet: bool = False) -> Iterator[str]:
        return sinks.text_report(self.ops, self.old, self.new, self.complete(), quiet)

    def git(self) -> Iterator[str]:
        return sinks.git_diff(self.ops, self.old, self.new)

    def payload(self) -> dict[str, DataFrame]:
        """What a viewer needs: operations, aligned axes, rectangles of interest, cells to show."""
        shapes = self.parts["sheets"]
        of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
        wide = shapes.groupBy("pair_id", "sheet").agg(*[F.coalesce(of(s, c), F.lit(0)).alias(f"{s}_{c}") for s in ("old", "new") for c in ("nrows", "ncols")])
        axis = lambda c: wide.select("pair_id", "sheet", F.col(f"old_{c}").alias("old_n"), F.col(f"new_{c}").alias("new_n"))
        rects = views.interest(self.ops, wide)
        cells = self.parts["cells"]
        return {
            "ops": self.numbered(), "rows": views.axis(self.ops, axis("nrows"), most=views.MAX_ROWS), "columns": views.axis(self.ops, axis("ncols"), rows=False, most=views.MAX_COLS),
            "interest": rects,
            **{s: views.snapshot(cells.where(F.col("side") == s).drop("side"), rects, s) for s in ("old", "new")},
        }


def limited(found: DataFrame, warnings: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """The first operations in order, and a warning for pairs that have more; the limit is what the caller asks for."""
    if most is None:
        return found, warnings
    over = found.groupBy("pair_id").count().where(F.col("count") > most)
    told = over.select("pair_id", F.format_string("more than %d operations: the rest is left out", F.lit(most)).alias("warning"))
    return found.orderBy(*ORDER).limit(most), warnings.unionByName(told)


def _sided(df: DataFrame, side: str, pair: DataFrame | None) -> DataFrame:
    if pair is None:
        return df.withColumn("pair_id", F.lit("")).withColumn("side", F.lit(side))
    return df.join(pair.where(F.col("side") == side), "path")


def _both(old: DataFrame, new: DataFrame, of, pair: DataFrame | None = None) -> DataFrame:
    return _sided(of(old), "old", pair).unionByName(_sided(of(new), "new", pair))


def diff_records(old: DataFrame, new: DataFrame, cfg: DiffConfig, store: Store, pair: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Operations, warnings, and cells and sheets, from records of workbooks. pair(path, pair_id, side) tells many apart."""
    old, new = store.save(old, "old"), store.save(new, "new")
    sheets = _both(old, new, books.sheets, pair).select("pair_id", "side", "sheet", "sheet_id", F.lit("Worksheet").alias("kind"), F.col("n_rows").alias("nrows"), F.col("n_cols").alias("ncols"), "position")
    cells = _both(old, new, books.cells, pair).drop("path")
    # sheets whose parts are the same bytes are not compared
    prints = _both(old, new, books.fingerprints, pair)
    same = prints.groupBy("pair_id", "sheet").agg(F.count_distinct("print").alias("n"), F.count_distinct("side").alias("sides")).where("n = 1 and sides = 2").select("pair_id", "sheet")
    found, warnings = workbook.grid_diff(cells.join(same, ["pair_id", "sheet"], "left_anti"), sheets, cfg, store)
    names = _both(old, new, books.names, pair).withColumn("position", F.monotonically_increasing_id())
    charts = _both(old, new, books.charts, pair).withColumn("position", F.monotonically_increasing_id())
    found = found.unionByName(objects.named_ranges(names)).unionByName(objects.charts(charts))
    broken = _both(old, new, lambda d: d.where("kind = 'error'").select("path", "txt"), pair)
    warnings = warnings.unionByName(broken.select("pair_id", F.concat_ws(": ", "path", "txt").alias("warning")))
    return found, warnings, {"cells": cells, "sheets": sheets}


def _queries(old: DataFrame, new: DataFrame, pair: DataFrame | None = None) -> DataFrame:
    of = lambda kind: _both(old, new, lambda d: d.where(F.col("kind") == kind), pair)
    section = F.when(F.col("embedded").isNull(), F.col("section")).otherwise(F.concat("embedded", F.lit("/"), "section"))
    members = of("member").withColumn("section", section)
    return objects.with_metadata(members, of("metadata"))


def diff_packages(old: DataFrame, new: DataFrame, cfg: DiffConfig, pair: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Operations on queries and models, and warnings, from records of packages."""
    of = lambda kind: _both(old, new, lambda d: d.where(F.col("kind") == kind), pair)
    found = objects.queries(_queries(old, new, pair), cfg)
    columns = of("column").withColumn("table", F.col("tbl"))
    found = found.unionByName(objects.model(of("table"), columns, of("measure"), of("relationship"), cfg))
    return found, of("error").select("pair_id", F.concat_ws(": ", "path", "txt").alias("warning"))


def diff_workbooks(spark: SparkSession, old: str, new: str, cfg: DiffConfig | None = None) -> DiffResult:
    """Two workbook files: sheets and cells, names, charts, queries."""
    cfg = (cfg or DiffConfig()).validate()
    store = Store(spark)
    found, warnings, parts = diff_records(books.scan(spark, old), books.scan(spark, new), cfg, store)
    more, told = diff_packages(store.save(mashup.scan(spark, old), "old_packages"), store.save(mashup.scan(spark, new), "new_packages"), cfg)
    out, warnings = limited(found.unionByName(more), warnings.unionByName(told), cfg.max_ops)
    return DiffResult(store.save(out, "ops"), store.save(warnings, "warnings"), old, new, parts)


def diff_bi(spark: SparkSession, old: str, new: str, cfg: DiffConfig | None = None) -> DiffResult:
    """Two BI packages: queries, then model."""
    cfg, store = (cfg or DiffConfig()).validate(), Store(spark)
    found, warnings = diff_packages(store.save(mashup.scan(spark, old), "old"), store.save(mashup.scan(spark, new), "new"), cfg)
    out, warnings = limited(found, warnings, cfg.max_ops)
    return DiffResult(store.save(out, "ops"), store.save(warnings, "warnings"), old, new)


def diff_batch(spark: SparkSession, old: str, new: str, cfg: DiffConfig | None = None, glob: str = "*.xls[xm]", by_name: bool = False) -> tuple[DiffResult, DataFrame]:
    """All workbooks of two folders in one plan, and how files pair up: path, n_old, n_new, status. Only files that pair
    one to one are compared; pair_id is their path below the folder."""
    cfg, store = (cfg or DiffConfig()).validate(), Store(spark)
    pairs = store.save(objects.pairing(folders.file_sets(spark, old, new, glob, by_name=by_name), "path", "side"), "pairs")
    a, b = store.save(books.scan(spark, old, glob), "records_old"), store.save(books.scan(spark, new, glob), "records_new")

    def keyed_paths(df: DataFrame, root: str, side: str) -> DataFrame:
        path = F.lower(folders.relative(F.col("path"), root))
        named = df.select("path").distinct().withColumn("pair_id", F.substring_index(path, "/", -1) if by_name else path)
        return named.join(pairs.where("status = 'pending'").select(F.col("path").alias("pair_id")), "pair_id").withColumn("side", F.lit(side))

    pair = store.save(keyed_paths(a, old, "old").unionByName(keyed_paths(b, new, "new")), "paths")
    found, warnings, parts = diff_records(a, b, cfg, store, pair)
    out, warnings = limited(found, warnings, cfg.max_ops)
    out, warnings = store.save(out, "ops"), store.save(warnings, "warnings")
    n = out.groupBy("pair_id").agg(F.count("*").alias("op_count"))
    told = warnings.groupBy("pair_id").agg(F.count("*").alias("warnings"))
    status = pairs.join(n, pairs["path"] == n["pair_id"], "left").drop("pair_id").join(told, F.col("path") == told["pair_id"], "left").drop("pair_id")
    status = status.withColumn("status", F.when(F.col("status") == "pending", "done").otherwise(F.col("status"))).fillna(0, ["op_count", "warnings"])
    return DiffResult(out, warnings, old, new, parts), status


def diff_tables(old: DataFrame, new: DataFrame, keys: list[str] | None = None, compare: list[str] | None = None) -> DataFrame:
    """Two tables by key: see operators.keyed. Without keys the old table's columns are searched for them."""
    keys = keys or keyed.choose_keys(old, old.columns)
    if not keys:
        raise DiffError("NO_KEY", "no columns, or several alike, can be the key; name them")
    return keyed.keyed_diff(old, new, keys, compare or [c for c in old.columns if c not in keys])


def frame_cells(df: DataFrame, order: list[str], side: str, sheet: str = "table") -> tuple[DataFrame, DataFrame]:
    """A table as cells and a sheet: rows in the order of columns, the header left out. Rows are numbered in salted groups."""
    from pyspark.sql import Window

    names = df.columns
    # ranges of the order columns hold consecutive rows, so numbers come from counts of partitions
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    n = sorted_.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    n = n.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    rows = sorted_.join(n, "__part").withColumn("row", F.col("__id") - F.col("__first") + F.col("__before"))
    kinds = dict(df.dtypes)

    def cell(i: int, c: str):
        text, flag = kinds[c] in ("string", "date", "timestamp"), kinds[c] == "boolean"
        kind = F.when(F.col(f"`{c}`").isNotNull(), "text" if text else "bool" if flag else "number")
        num = F.lit(None).cast("double") if text or flag else F.col(f"`{c}`").cast("double")
        return F.struct(F.lit(i).cast("bigint").alias("col"), kind.alias("vkind"), num.alias("num"), (F.col(f"`{c}`").cast("string") if text else F.lit(None).cast("string")).alias("txt"), (F.col(f"`{c}`") if flag else F.lit(None).cast("boolean")).alias("flag"))

    each = rows.select("row", F.explode(F.array(*[cell(i, c) for i, c in enumerate(names)])).alias("c")).select("row", "c.*").where("vkind is not null")
    cells = each.select(F.lit("").alias("pair_id"), F.lit(side).alias("side"), F.lit(sheet).alias("sheet"), "row", "col", "vkind", "num", "txt", "flag", F.lit(None).cast("string").alias("formula"))
    shape = df.agg(F.count("*").alias("nrows")).select(F.lit("").alias("pair_id"), F.lit(side).alias("side"), F.lit(sheet).alias("sheet"), F.lit(1).alias("sheet_id"), F.lit("Worksheet").alias("kind"), "nrows", F.lit(len(names)).alias("ncols"), F.lit(0).alias("position"))
    return cells, shape


def diff_grids(old: DataFrame, new: DataFrame, order: list[str], cfg: DiffConfig | None = None) -> DiffResult:
    """Two tables as sheets: rows in order, aligned, with inserted, removed and moved rows and columns."""
    store = Store(old.sparkSession)
    (a, s), (b, t) = frame_cells(old, order, "old"), frame_cells(new, order, "new")
    cells, sheets = store.save(a.unionByName(b), "input_cells"), s.unionByName(t)
    found, warnings = workbook.grid_diff(cells, sheets, cfg, store)
    return DiffResult(found, warnings, parts={"cells": cells, "sheets": sheets})


def choose_sheet(names: list[str], wanted: str | None) -> str:
    """The sheet of database mode: the one asked for, else Data, else the only one."""
    low = {n.lower(): n for n in names}
    if wanted is not None:
        if wanted.lower() not in low:
            raise DiffError("NO_SHEET", f"there is no sheet {wanted}")
        return low[wanted.lower()]
    if "data" in low:
        return low["data"]
    if len(names) == 1:
        return names[0]
    raise DiffError("NO_SHEET", "name the sheet to compare")


def key_columns(text: str) -> list[int]:
    """Zero-based columns of a list of column letters such as A,C."""
    out = []
    for part in (p.strip().upper() for p in text.split(",")):
        if not part.isascii() or not part.isalpha() or len(part) > 3:
            raise DiffError("BAD_KEYS", f"{part or 'an empty name'} is no column")
        n = reduce(lambda a, c: a * 26 + ord(c) - 64, part, 0) - 1
        if n in out:
            raise DiffError("BAD_KEYS", f"{part} is there twice")
        out.append(n)
    return out


def suggest_sheet_keys(cells: DataFrame, sheet: str) -> list[int]:
    """Key columns of an old sheet with a header in its first row."""
    mine = cells.where((F.lower("sheet") == sheet.lower()) & (F.col("side") == "old"))
    value = F.coalesce("txt", F.col("num").cast("string"), F.col("flag").cast("string"))
    heads = {r["col"]: r["v"] for r in mine.where("row = 0").select("col", value.alias("v")).collect()}  # a row of one sheet
    used = sorted(r["col"] for r in mine.select("col").distinct().collect())
    label = {c: f"{c}:{heads.get(c) or ''}" for c in used}
    wide = mine.where("row > 0").groupBy("row").agg(*[F.max(F.when(F.col("col") == c, value)).alias(f"c{c}") for c in used])
    named = wide.select(*[F.col(f"c{c}").alias(label[c].replace(".", "_").replace("`", "_")) for c in used])
    found = keyed.choose_keys(named, named.columns) if used else []
    return [int(c.split(":")[0]) for c in found]


def diff_database(spark: SparkSession, old: str, new: str, keys: str | None = None, sheet: str | None = None, cfg: DiffConfig | None = None) -> DiffResult:
    """A sheet of two workbooks as tables by key columns (letters), or by keys that the old sheet suggests. Where no key
    fits, sheets are compared as sheets, with a warning."""
    cfg, store = (cfg or DiffConfig()).validate(), Store(spark)
    a, b = store.save(books.scan(spark, old), "old"), store.save(books.scan(spark, new), "new")
    names = [r[0] for r in books.sheets(a).select("sheet").distinct().orderBy("sheet").collect()]  # sheets of one workbook
    chosen = choose_sheet(names, sheet)
    cells = _both(a, b, books.cells).drop("path").where(F.lower("sheet") == chosen.lower()).withColumn("sheet", F.lit(chosen))
    cols = key_columns(keys) if keys else suggest_sheet_keys(cells, chosen)
    if not cols:
        out = diff_workbooks(spark, old, new, cfg)
        told = spark.createDataFrame([("", "no key columns: compared as sheets")], "pair_id string, warning string")
        return DiffResult(out.ops, out.warnings.unionByName(told), old, new, out.parts)
    found = store.save(database.database_diff(cells, cols, cfg), "ops")
    none = spark.createDataFrame([], "pair_id string, warning string")
    out, warnings = limited(found, none, cfg.max_ops)
    return DiffResult(out, warnings, old, new)


@dataclass
class ProjectDiff:
    documents: DataFrame
    entities: DataFrame

    def roll_up(self) -> DataFrame:
        return project.roll_up(self.documents, self.entities)

    def markdown(self) -> Iterator[str]:
        return sinks.project_markdown(self.documents, self.entities)


def diff_projects(spark: SparkSession, old: str, new: str, profile: str = "balanced") -> ProjectDiff:
    """Two project folders: documents by path, and their parts."""
    store = Store(spark)
    a, b = (store.save(project.snapshot(folders.documents(spark, root), profile), name) for root, name in ((old, "old"), (new, "new")))
    docs = store.save(project.documents(a, b), "documents")
    return ProjectDiff(docs, store.save(project.entities(a, b, docs), "entities"))


def info(spark: SparkSession, path: str) -> DataFrame:
    """Sheets and queries of a workbook."""
    found = books.scan(spark, path)
    q = mashup.scan(spark, path)
    sided = lambda d: d.withColumn("pair_id", F.col("path")).withColumn("side", F.lit("old"))
    queries = objects.with_metadata(sided(q.where("kind = 'member'")), sided(q.where("kind = 'metadata'"))).withColumnRenamed("pair_id", "path")
    return views.info(books.sheets(found), queries)


def column_names(columns: list[int], spark: SparkSession) -> list[str]:
    """Letters of zero-based columns."""
    df = spark.createDataFrame([(c,) for c in columns], "c int")
    return [r[0] for r in df.select(letters(F.col("c"))).collect()]


__all__ = [
    "DiffConfig", "DiffError", "DiffResult", "ProjectDiff", "diff_batch", "diff_bi", "diff_database", "diff_grids", "diff_projects", "diff_tables", "diff_workbooks",
    "info", "ops",
]
