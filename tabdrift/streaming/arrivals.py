"""New versions of workbooks that arrive in a folder, each compared with the version of the same path in another one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import api, sinks
from ..config import DiffConfig
from ..sources import project as folders
from ..sources import workbook as books
from ..store import Store

_FILES = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, arriving: str, base: str, target: str, checkpoint: str, cfg: DiffConfig | None = None, glob: str = "*.xls[xm]") -> StreamingQuery:
    """Starts a query that compares what arrives and appends the operations to a store at target, with the batch's number
    as diff_id. A batch that is run again after a failure first drops what it had written."""
    cfg = (cfg or DiffConfig()).validate()

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        path = F.lower(folders.relative(F.col("path"), arriving))
        new = batch.withColumn("pair_id", path)
        store = Store(session)
        arrived = store.save(new.select("path", "pair_id"), "arrived")
        old = session.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
        old = old.withColumn("pair_id", F.lower(folders.relative(F.col("path"), base))).join(arrived.select("pair_id").distinct(), "pair_id", "left_semi")
        pair = arrived.withColumn("side", F.lit("new")).unionByName(old.select("path", "pair_id").withColumn("side", F.lit("old")))
        pair = store.save(pair, "paths")
        found, _, _ = api.diff_records(books.records(old), books.records(new), cfg, store, pair)
        folder = session._jvm.org.apache.hadoop.fs.Path(f"{target}/diff_id={number}")
        folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)
        sinks.op_store(found, target, str(number))

    stream = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(arriving)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
