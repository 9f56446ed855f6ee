"""Cells in long form (row, col, num, txt), positional diff, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import same_number
from .align import increasing


def cells(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """Long form: one row per non-null cell. row names the zero-based row index."""
    kinds = dict(df.dtypes)
    num = lambda c: F.lit(None).cast("double") if kinds[c] == "string" else F.col(c).cast("double")
    txt = lambda c: F.col(c) if kinds[c] == "string" else F.lit(None).cast("string")
    one = F.array(*[F.struct(F.lit(i).alias("col"), num(c).alias("num"), txt(c).alias("txt")) for i, c in enumerate(columns)])
    out = df.select(F.col(row).cast("long").alias("row"), F.explode(one).alias("c")).select("row", "c.*")
    return out.where("num is not null or txt is not null")


def positional(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells that differ at the same place, either side being absent or not: one full outer join on (row, col)."""
    side = lambda d, p: d.select("row", "col", F.col("num").alias(f"{p}_num"), F.col("txt").alias(f"{p}_txt"))
    both = side(old, "from").join(side(new, "to"), ["row", "col"], "full")
    return both.where(~(same_number(F.col("from_num"), F.col("to_num")) & F.col("from_txt").eqNullSafe(F.col("to_txt"))))


def islands(df: DataFrame, group: list[str], at: str) -> DataFrame:
    """Runs of consecutive numbers within groups: group, first, last, n."""
    w = Window.partitionBy(*group).orderBy(at)
    marked = df.withColumn("__island", F.col(at) - F.row_number().over(w))
    return marked.groupBy(*group, "__island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("__island")


def joined_islands(df: DataFrame, group: list[str], at: str, block: int) -> DataFrame:
    """islands, but a long group is ordered by blocks of rows: runs that touch a block's edge are joined afterwards."""
    blocks = df.withColumn("__block", F.floor(F.col(at) / block))
    parts = islands(blocks, [*group, "__block"], at).drop("__block")
    open_ = (F.pmod("first", F.lit(block)) == 0) | (F.pmod(F.col("last") + 1, F.lit(block)) == 0)
    w = Window.partitionBy(*group).orderBy("first")  # at most two runs for each block
    new = F.coalesce((F.col("first") != F.lag("last").over(w) + 1).cast("int"), F.lit(1))
    marked = parts.where(open_).withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    whole = marked.groupBy(*group, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("__run")
    return parts.where(~open_).unionByName(whole)


def runs(df: DataFrame, group: list[str], at: str, value: str) -> DataFrame:
    """Runs of equal consecutive values in the order of at: group, value, first, last, n."""
    w = Window.partitionBy(*group).orderBy(at)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(at).over(w).isNull()).cast("int")
    marked = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    return marked.groupBy(*group, "__run", value).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("__run")


def both_counts(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Frequencies of signatures on both sides: by, freq_a, freq_b; one shuffle with map-side combining."""
    both = old.select(*by, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(new.select(*by, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy(*by).agg(F.sum("a").alias("freq_a"), F.sum("b").alias("freq_b"))


def multiset_distance(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """(differing, distance): rows whose signature the other side lacks, and half of them: what an edit of rows costs."""
    n = both_counts(old, new, by).agg(F.sum(F.abs(F.col("freq_a") - F.col("freq_b"))).alias("differing"))
    return n.select("differing", F.floor(F.col("differing") / 2).alias("distance"))


def in_order(old: DataFrame, new: DataFrame, at: str, sig: str) -> DataFrame:
    """(n, n_match, ratio) of rows at equal places."""
    both = old.select(at, F.col(sig).alias("__a")).join(new.select(at, F.col(sig).alias("__b")), at)
    match = F.count_if(F.col("__a").eqNullSafe(F.col("__b")))
    return both.agg(F.count("*").alias("n"), match.alias("n_match"), (match / F.greatest(F.count("*"), F.lit(1))).alias("ratio"))


def sampled_sets(old: DataFrame, new: DataFrame, group: str, at: str, sig: str, most: int = 4096) -> DataFrame:
    """(group, n_both, n_either): distinct signatures that both sides share and that either has, among every (n / most)-th
    row by place, at most that many, and the last row. n is that of the old side."""
    n = old.groupBy(group).agg(F.count("*").alias("__n"))
    step = F.greatest(F.floor(F.col("__n") / F.least(F.col("__n"), F.lit(most))), F.lit(1))
    picked = ((F.col(at) % step == 0) & (F.floor(F.col(at) / step) < most)) | (F.col(at) == F.col("__n") - 1)
    some = lambda d: d.join(n, group).where(picked).select(group, sig)
    f = both_counts(some(old), some(new), [group, sig])
    return f.groupBy(group).agg(F.count_if((F.col("freq_a") > 0) & (F.col("freq_b") > 0)).alias("n_both"), F.count("*").alias("n_either"))


def first_and_last_difference(both: DataFrame, group: list[str], at: str, a: str, b: str) -> DataFrame:
    """group, n, first_differing, last_differing: what stands before the first is a common prefix, after the last a suffix."""
    differing = F.when(~F.col(a).eqNullSafe(F.col(b)), F.col(at))
    return both.groupBy(*group).agg(F.count("*").alias("n"), F.min(differing).alias("first_differing"), F.max(differing).alias("last_differing"))


def contexts(df: DataFrame, group: list[str], at: str, sig: str, k: int) -> DataFrame:
    """Signatures of each k rows in a row, at the first one."""
    w = Window.partitionBy(*group).orderBy(at)
    return df.select(*group, at, F.concat(sig, *[F.lead(sig, i).over(w) for i in range(1, k)]).alias("context")).where("context is not null")


def with_context(rows: DataFrame, group: list[str], at: str, k: int, size: str) -> DataFrame:
    """Rows and those up to k places before and after them, within 0 and size, each once."""
    near = F.sequence(F.greatest(F.col(at) - k, F.lit(0)), F.least(F.col(at) + k, F.col(size) - 1))
    return rows.select(*group, F.explode(near).alias(at)).distinct()


def frequency_class(n, rare: int = 5, bare=None):
    """Unique, Rare or Common by the number of rows; LowInfo where a row says too little."""
    out = F.when(n == 1, "Unique").when(n <= rare, "Rare").otherwise("Common")
    return out if bare is None else F.when(bare, "LowInfo").otherwise(out)


def hash_stats(old: DataFrame, new: DataFrame, by: list[str], at: str, limit: int = 8) -> DataFrame:
    """by, freq_a, freq_b, first place on both sides, and whether a side has it more often than alignment can use."""
    side = lambda d, a, b: d.select(*by, F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.lit(a == 1), F.col(at)).alias("pa"), F.when(F.lit(b == 1), F.col(at)).alias("pb"))
    n = side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy(*by).agg(F.sum("a").alias("freq_a"), F.sum("b").alias("freq_b"), F.min("pa").alias("first_a"), F.min("pb").alias("first_b"))
    return n.withColumn("heavy", F.greatest("freq_a", "freq_b") > limit)


def anchors(old: DataFrame, new: DataFrame, sig: str, at: str, group: list[str] = []) -> DataFrame:  # noqa: B006
    """Signatures that either side has exactly once, within groups such as sheets: group, sig, row_a, row_b."""
    once = lambda d, name: d.groupBy(*group, sig).agg(F.count("*").alias("k"), F.min(at).alias(name)).where("k = 1").drop("k")
    return once(old, "row_a").join(once(new, "row_b"), [*group, sig])


def shifted(pairs: DataFrame, a: str, b: str, group: list[str] = []) -> DataFrame:  # noqa: B006
    """Moves: runs of at least two matched rows with one offset that isn't zero: group, offset, first, last, n."""
    found = pairs.select(*group, (F.col(b) - F.col(a)).alias("offset"), a).where("offset <> 0")
    return joined_islands(found, [*group, "offset"], a, 100_000).where("n > 1")


def fifo(old: DataFrame, new: DataFrame, sig: str, at: str) -> DataFrame:
    """The k-th old occurrence of a signature with its k-th new one."""
    w = Window.partitionBy(sig).orderBy(at)
    side = lambda d, name: d.select(sig, F.col(at).alias(name), F.row_number().over(w).alias("k"))
    return side(old, "row_a").join(side(new, "row_b"), [sig, "k"])


def anchor_chain(found: DataFrame, group: str) -> DataFrame:
    """Anchors of each sheet that keep their order: (group, row_a, row_b), one sheet's unique signatures in a kernel."""

    def kernel(df):
        import pandas as pd

        df = df.sort_values("row_b")
        kept = increasing(df["row_a"].tolist())
        part = df.iloc[kept]
        return pd.DataFrame({group: part[group], "row_a": part["row_a"], "row_b": part["row_b"]})

    return found.groupBy(group).applyInPandas(kernel, f"{group} {dict(found.dtypes)[group]}, row_a long, row_b long")
