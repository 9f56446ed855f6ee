"""Database mode: sheets compared as tables by key columns, and what lies outside the table by place.

Rows whose key cells are all filled make the table; columns filled in half of them, and the keys, are compared. Rows
match by key, wherever they stand; keys are null-safe, numbers by 15 digits. Keys that a side has more than once form
clusters, matched inside as in operators.keyed. Cells outside the table's bounding box are compared at their places;
inside it, rows without keys and sparse columns aren't compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DiffConfig
from ..functions import formula
from ..operators.keyed import EXACT, LARGEST, match_cluster
from ..schema import CELL, ops
from ..store import Store
from .workbook import cell_struct, comparable

PLACE = ["pair_id", "sheet"]
#: Share of a table's rows in which a column is filled.
FILLED = 0.5


def table_rows(cells: DataFrame, keys: list[int]) -> DataFrame:
    """Rows of tables: pair_id, sheet, side, row, key (comparable values), cells by column."""
    some = cells.where("(vkind is not null or formula is not null) and row is not null and col is not null")
    c = some.select(*PLACE, "side", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), cell_struct().alias("cell"))
    value = F.when(F.col("cell.vkind") == "blank", None).otherwise(comparable(F.col("cell")))
    parts = [F.max(F.when(F.col("col") == k, F.to_json(value))).alias(f"k{i}") for i, k in enumerate(keys)]
    rows = c.groupBy(*PLACE, "side", "row").agg(*parts, F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("cells"))
    filled = rows.where(" and ".join(f"k{i} is not null" for i in range(len(keys))))
    return filled.select(*PLACE, "side", "row", F.array(*[f"k{i}" for i in range(len(keys))]).alias("key"), "cells")


def compared_columns(rows: DataFrame, keys: list[int]) -> DataFrame:
    """pair_id, sheet, cols: columns, other than keys, that are filled in half of the rows of a side."""
    n = rows.groupBy(*PLACE, "side").agg(F.count("*").alias("n"))
    each = rows.select(*PLACE, "side", F.explode(F.filter(F.map_entries("cells"), lambda e: F.coalesce(e["value"]["vkind"] != "blank", F.lit(False)) | e["value"]["formula"].isNotNull())).alias("e"))
    filled = each.groupBy(*PLACE, "side", F.col("e.key").alias("col")).agg(F.count("*").alias("m")).join(n, [*PLACE, "side"])
    kept = filled.where((F.col("m") >= FILLED * F.col("n")) & ~F.col("col").isin(*keys))
    return kept.groupBy(*PLACE).agg(F.array_sort(F.collect_set("col")).alias("cols"))


def _ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with each row's place in its group by row, from 1. Counted in blocks of rows, so no task holds a whole group."""
    blocked = df.withColumn("block", F.floor(F.col("row") / 65_536))
    counts = blocked.groupBy(*by, "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.withColumn("before", before).drop("n")
    at = blocked.withColumn("at", F.row_number().over(Window.partitionBy(*by, "block").orderBy("row")))
    return at.join(first, [*by, "block"]).withColumn(name, F.col("at") + F.col("before")).drop("block", "before", *(["at"] if name != "at" else []))


def _matched(df):
    """Differing rows of one key, at most LARGEST a side: (row_a, row_b) pairs and rows left over."""
    import json

    import pandas as pd

    df = df.sort_values("row")
    sides = {s: df[df["side"] == s] for s in ("old", "new")}
    values = {s: [tuple(json.loads(v)) for v in d["v"]] for s, d in sides.items()}
    rows = {s: d["row"].tolist() for s, d in sides.items()}
    pairs = match_cluster(values["old"], values["new"], bool(df["size"].iloc[0] <= EXACT))
    used_a, used_b = {i for i, _ in pairs}, {j for _, j in pairs}
    out = [(rows["old"][i], rows["new"][j]) for i, j in pairs]
    out += [(r, None) for i, r in enumerate(rows["old"]) if i not in used_a] + [(None, r) for j, r in enumerate(rows["new"]) if j not in used_b]
    return pd.DataFrame({
        "pair_id": [df["pair_id"].iloc[0]] * len(out), "sheet": [df["sheet"].iloc[0]] * len(out), "key": [df["key"].iloc[0]] * len(out),
        "row_a": pd.array([a for a, _ in out], dtype="Int64"), "row_b": pd.array([b for _, b in out], dtype="Int64"),
    })


def match_inside(listed: DataFrame, store: Store) -> DataFrame:
    """pair_id, sheet, key, row_a, row_b for listed(pair_id, sheet, key, size, side, row, v), v being the compared values.

    Rows with equal values pair off first, in the order of rows, by one aggregation; a key that very many rows share
    comes down to its differing rows. Of these the first LARGEST a side are matched, the others are told as they are."""
    group = [*PLACE, "key", "size"]
    ranked = _ranked(listed, [*group, "side", "v"], "k")
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("row")))
    paired = store.save(ranked.groupBy(*group, "v", "k").agg(of("old").alias("row_a"), of("new").alias("row_b")), "paired")
    equal = paired.where("row_a is not null and row_b is not null")
    left = paired.where("row_a is null or row_b is null").select(*group, "v", F.when(F.col("row_a").isNull(), "new").otherwise("old").alias("side"), F.coalesce("row_a", "row_b").alias("row"))
    placed = store.save(_ranked(left, [*group, "side"], "at"), "placed")
    schema = "pair_id string, sheet string, key array<string>, row_a long, row_b long"
    near = placed.where(F.col("at") <= LARGEST).groupBy(*PLACE, "key").applyInPandas(_matched, schema)
    own = lambda s: F.when(F.col("side") == s, F.col("row"))
    rest = placed.where(F.col("at") > LARGEST).select(*PLACE, "key", own("old").alias("row_a"), own("new").alias("row_b"))
    return near.unionByName(rest).unionByName(equal.select(*PLACE, "key", "row_a", "row_b"))


def database_diff(cells: DataFrame, keys: list[int], cfg: DiffConfig | None = None) -> DataFrame:
    """Operations of sheets that both sides have, in the order removed, added, edits, clusters with what is in them, cells
    outside the table. cells have sheet names that are equal on both sides."""
    cfg, store = cfg or DiffConfig(), Store(cells.sparkSession)
    rows = store.save(table_rows(cells, keys), "rows")
    cols = store.save(compared_columns(rows, keys), "columns")
    n = rows.groupBy(*PLACE, "key").agg(F.count_if(F.col("side") == "old").alias("a"), F.count_if(F.col("side") == "new").alias("b"))
    many = n.where("a > 1 or b > 1").select(*PLACE, "key", F.greatest("a", "b").alias("size"))
    single = rows.join(many, [*PLACE, "key"], "left_anti").groupBy(*PLACE, "key").agg(
        F.max(F.when(F.col("side") == "old", F.col("row"))).alias("row_a"), F.max(F.when(F.col("side") == "new", F.col("row"))).alias("row_b")
    )
    shared = rows.join(many, [*PLACE, "key"]).join(cols, PLACE, "left")
    values = F.transform(F.coalesce("cols", F.array().cast("array<bigint>")), lambda c: F.to_json(comparable(F.col("cells")[c])))
    inside = match_inside(shared.select(*PLACE, "key", "size", "side", "row", F.to_json(values).alias("v")), store)
    text = F.array_join("key", ",")
    base = {"phase": F.lit(0), "sheet_ord": F.lit(0)}

    def told(found: DataFrame, name: str, grp: tuple[int, int, int], lead) -> DataFrame:
        """Rows that one side lacks, and edits of the others. Matches and differing cells are written: both are read again."""
        found = store.save(found, name)
        gone = ops(found.where("row_b is null"), **base, grp=F.lit(grp[0]), s1=lead(F.col("row_a")), s2=F.lit(1 << 40), kind=F.lit("RowRemoved"), row=F.col("row_a"), row_end=F.col("row_a"), key=text)
        come = ops(found.where("row_a is null"), **base, grp=F.lit(grp[1]), s1=lead(F.col("row_b")), s2=F.lit((1 << 40) + 1), kind=F.lit("RowAdded"), row=F.col("row_b"), row_end=F.col("row_b"), key=text)
        side = lambda s, at: rows.where(F.col("side") == s).select(*PLACE, F.col("row").alias(at), F.col("cells").alias(s))
        both = found.where("row_a is not null and row_b is not null").join(side("old", "row_a"), [*PLACE, "row_a"]).join(side("new", "row_b"), [*PLACE, "row_b"]).join(cols, PLACE)
        each = both.select(*found.columns, F.explode(F.transform("cols", lambda c: F.struct(c.alias("col"), F.col("old")[c].alias("before"), F.col("new")[c].alias("after")))).alias("c")).select(*found.columns, "c.*")
        same = comparable(F.col("before")).eqNullSafe(comparable(F.col("after")))
        each = each.where((F.col("before").isNull() != F.col("after").isNull()) | (F.col("before").isNotNull() & ~same))
        each = store.save(each.withColumn("fa", F.col("before.formula")).withColumn("fb", F.col("after.formula")), f"{name}_edits")
        each = formula.with_change(each, "fa", "fb", F.col("row_b") - F.col("row_a"), F.lit(0)) if cfg.enable_formula_semantic_diff else each.withColumn("formula_diff", formula.plain_change(F.col("fa"), F.col("fb")))
        empty = F.lit(None).cast(CELL)
        edits = ops(
            each, **base, grp=F.lit(grp[2]), s1=lead(F.col("row_b")), s2=F.col("col"), kind=F.lit("CellEdited"), row=F.col("row_b"), row_end=F.col("row_b"), col_end=F.col("col"), key=text,
            **{"from": F.coalesce("before", empty), "to": F.coalesce("after", empty)},
        )
        return gone.unionByName(come).unionByName(edits)

    out = told(single, "single", (0, 1, 2), lambda row: row)
    heads = rows.join(many, [*PLACE, "key"]).groupBy(*PLACE, "key").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "old", F.col("row")))).alias("left_rows"), F.array_sort(F.collect_list(F.when(F.col("side") == "new", F.col("row")))).alias("right_rows"),
        F.min("row").alias("row"), F.max("row").alias("row_end"),
    )
    first = heads.select(*PLACE, "key", F.col("row").alias("lead"))
    out = out.unionByName(ops(heads, **base, grp=F.lit(3), s1=F.col("row"), s2=F.lit(-1), kind=F.lit("DuplicateKeyCluster"), key=text))
    out = out.unionByName(told(inside.join(first, [*PLACE, "key"]), "inside", (3, 3, 3), lambda row: F.col("lead")))
    return out.unionByName(_outside(cells, rows, cols, keys, cfg))


def _outside(cells: DataFrame, rows: DataFrame, cols: DataFrame, keys: list[int], cfg: DiffConfig) -> DataFrame:
    """Edits of cells outside the table's bounding box on their side's table."""
    key_cols = F.array(*[F.lit(k).cast("bigint") for k in keys])
    width = F.coalesce("cols", F.array().cast("array<bigint>"))
    box = rows.groupBy(*PLACE, "side").agg(F.min("row").alias("r0"), F.max("row").alias("r1")).join(cols, PLACE, "left")
    box = box.select(*PLACE, "side", "r0", "r1", F.array_min(F.concat(width, key_cols)).alias("c0"), F.array_max(F.concat(width, key_cols)).alias("c1"))
    box = box.groupBy(*PLACE).agg(*[F.min(c).alias(c) for c in ("r0", "c0")], *[F.max(c).alias(c) for c in ("r1", "c1")])
    some = cells.where("vkind is not null or formula is not null").select(*PLACE, "side", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), cell_struct().alias("cell"))
    free = some.join(box, PLACE, "left").where("r0 is null or row < r0 or row > r1 or col < c0 or col > c1")
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("cell")))
    both = free.groupBy(*PLACE, "row", "col").agg(of("old").alias("before"), of("new").alias("after"))
    same = comparable(F.col("before")).eqNullSafe(comparable(F.col("after"))) & (F.col("before").isNull() == F.col("after").isNull())
    differing = both.where(~same).withColumn("formula_diff", formula.plain_change(F.col("before.formula"), F.col("after.formula")))
    empty = F.lit(None).cast(CELL)
    return ops(
        differing, phase=F.lit(0), sheet_ord=F.lit(0), grp=F.lit(4), s1=F.col("row"), s2=F.col("col"), kind=F.lit("CellEdited"), row_end=F.col("row"), col_end=F.col("col"),
        **{"from": F.coalesce("before", empty), "to": F.coalesce("after", empty)},
    )
