"""Diffs of project folders: documents by path, and the pages, visuals, tables, measures, ... inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.documents import normal_form, parts_of


def snapshot(docs: DataFrame, profile: str = "balanced") -> DataFrame:
    """docs(path, raw) with kind, text in normal form, its hash and what went wrong."""
    done = docs.withColumn("n", normal_form(profile)("path", "raw"))
    return done.select("path", F.col("n.kind").alias("kind"), F.col("n.text").alias("text"), F.sha2("n.text", 256).alias("hash"), F.col("n.error").alias("error"))


def _both(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    side = lambda d, s: d.select(*keys, F.struct(*values).alias(s))
    return side(old, "old").join(side(new, "new"), keys, "full")


def documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind, change, impact) of documents that differ. Hashes are joined, texts stay where they are."""
    both = _both(old, new, ["path"], ["kind", "hash", "error"])
    differs = ~F.struct("old.hash", "old.error").eqNullSafe(F.struct("new.hash", "new.error"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(differs, "modified")
    a, b = F.coalesce("old.kind", F.lit("other")), F.coalesce("new.kind", F.lit("other"))
    kind = F.when(a == b, a).when(a == "other", b).when(b == "other", a).otherwise("other")
    out = both.select("path", kind.alias("kind"), change.alias("change")).where("change is not null")
    return out.withColumn("impact", F.when(F.col("kind") == "pbir", "Report").when(F.col("kind") == "tmdl", "Model"))


def entities(old: DataFrame, new: DataFrame, differing: DataFrame) -> DataFrame:
    """(path, kind, label, change, pointer, old_text, new_text) of the parts of differing documents."""
    kinds = differing.select("path", F.col("kind").alias("as"))
    parts = parts_of()

    def side(docs: DataFrame) -> DataFrame:
        some = docs.where("error is null").join(kinds, "path")
        return some.select("path", F.explode(parts("as", "text")).alias("e")).select("path", "e.*")

    both = _both(side(old), side(new), ["path", "kind", "label"], ["pointer", "text"])
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old.text") != F.col("new.text"), "modified")
    out = both.withColumn("change", change).where("change is not null")
    return out.select("path", "kind", "label", "change", F.coalesce("new.pointer", "old.pointer").alias("pointer"), F.col("old.text").alias("old_text"), F.col("new.text").alias("new_text"))


def roll_up(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Counts of changed documents (kind document) and parts, by path and in all (null path)."""
    each = docs.select("path", F.lit("document").alias("kind"), "change").unionByName(parts.select("path", "kind", "change"))
    return each.groupingSets([["path", "kind", "change"], ["kind", "change"]], "path", "kind", "change").agg(F.count("*").alias("n"))
