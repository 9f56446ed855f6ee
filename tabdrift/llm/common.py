"""Shared pieces: table access, scratch tables in the shared folder, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim() -> None:
    """Gives back to the system what an earlier task of this Python worker has freed; workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of these equals, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Written tables that cut lineage. They lie in the folder that spark.checkpoint.dir names, which all executors
    share, so a lost executor costs at most one stage. Only where that is unset and Spark runs on this machine alone (tests), a
    temporary folder is used. Python workers get batches of at most 1,000 rows in the whole session, as texts are long."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not (spark.sparkContext.master or "").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        self.root = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing will read again."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of frames that are gone; what was written stays."""
        gc.collect()
        self.spark._jvm.System.gc()


def spread_join(many: DataFrame, one: DataFrame, key: str, row: str, salts: int = 32) -> DataFrame:
    """many joined with one (a row per key), where a key may have a large share of many's rows: they are dealt out by row
    to as many groups, and each row of one goes to all of them."""
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64(row), F.lit(salts)))
    copied = one.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return dealt.join(copied, [key, "__salt"]).drop("__salt")


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc", most: int = 60) -> DataFrame:
    """Connected components of edges(a, b) by alternating large-star and small-star steps.

    Returns (node, component), component being the smallest node of the class; nodes without an edge to another node
    don't appear. Each step aggregates with map-side combining and joins back on the node, so a node with very many
    neighbours needs no single task; every round is a written table. Self loops and null ends are ignored. Rounds grow
    with the logarithm of a class's length; should most of them not do, the result would be wrong, so that is an error.
    """
    now = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}_0"
    )
    state = None
    for i in range(1, most + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node below all its neighbours keeps its edges: m is the node itself there
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.save(new, f"{tag}_{i}")
        scratch.drop(f"{tag}_{i - 1}")
        seen = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        now = new
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components have not settled in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


#: Byte table that lower-cases A-Z and turns every other ASCII byte outside 0-9 and a-z into a space; UTF-8 stays.
_WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: runs of digits, letters (A-Z lower-cased) and everything beyond ASCII."""
    return utf8(text).translate(_WORD_BYTES).split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
