"""The corpus pipeline: each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of documents, the last one packed sequences. Each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabdrift.llm import op04_decontaminate, op05_jaccard, op08_secrets, op09_quality_rules, op10_packing
from tabdrift.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail policy v1 go."""
    return op09_quality_rules.keep(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies and near copies stays, whether its rows have ids or not."""
    return op05_jaccard.keep_one(docs, Scratch(spark))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, each by its own text, whatever its id."""
    return op04_decontaminate.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking values are replaced in the texts, row by row, whatever the id; widely copied examples stay."""
    return op08_secrets.redact(docs, Scratch(spark))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and place."""
    scratch = Scratch(spark)
    return op10_packing.pack(scratch.save(op10_packing.pieces(docs), "pieces"), scratch)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenization and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}_{name}")
    return docs
