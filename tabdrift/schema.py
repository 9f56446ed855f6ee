"""Columns of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = "struct<vkind:string,num:double,txt:string,flag:boolean,formula:string>"
#: A row per operation. Operations go by phase, sheet_ord, grp, s1, s2; op_idx is derived from these on demand.
OPS = (
    ("pair_id", "string"), ("phase", "int"), ("sheet_ord", "int"), ("grp", "int"), ("s1", "bigint"), ("s2", "bigint"), ("kind", "string"),
    ("sheet", "string"), ("row", "bigint"), ("col", "bigint"), ("row_end", "bigint"), ("col_end", "bigint"), ("dst_row", "bigint"), ("dst_col", "bigint"),
    ("from", CELL), ("to", CELL), ("formula_diff", "string"), ("change_kind", "string"), ("field", "string"), ("name", "string"), ("name_to", "string"),
    ("tbl", "string"), ("old", "string"), ("new", "string"), ("key", "string"), ("left_rows", "array<bigint>"), ("right_rows", "array<bigint>"), ("detail", "string"),
)
ORDER = ["pair_id", "phase", "sheet_ord", "grp", "s1", "s2", "kind"]


def ops(df: DataFrame, **values: Column) -> DataFrame:
    """df as operations: the columns given here or found in df, the rest null."""
    have = {n for n, kind in df.dtypes if n not in ("old", "new") or not kind.startswith("struct")}
    pick = lambda n: values[n] if n in values else F.col(n) if n in have else F.lit(None)
    return df.select(*[pick(n).cast(kind).alias(n) for n, kind in OPS])


def numbered(df: DataFrame) -> DataFrame:
    """Operations with op_idx, counted from 0 within each pair of versions."""
    from pyspark.sql import Window

    return df.withColumn("op_idx", F.row_number().over(Window.partitionBy("pair_id").orderBy(*ORDER[1:])) - 1)
