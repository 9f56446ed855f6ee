"""Project folders as tables of documents, and the pairing of two folders' files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest file that is read, in bytes.
LARGEST = 10 << 20
#: Folders that hold no documents of the project.
IGNORED = (".git", ".pbi", "target", "node_modules", ".venv", ".idea", ".vscode")


def relative(path: Column, root: str) -> Column:
    """Path below a folder, wherever the folder lies: what follows the folder's own path."""
    folder = root.split("://", 1)[-1].rstrip("/")
    folder = folder[folder.find("/") :] if "://" in root and not root.startswith("file:") else folder
    return F.regexp_replace(path, rf"^.*?\Q{folder}\E/+", "")


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def documents(spark: SparkSession, root: str, glob: str = "*", ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path below root, raw, skipped): text files, read by the executors; larger files are listed without text, files in
    ignored folders not at all."""
    files = _files(spark, root, glob).withColumn("path", relative(F.col("path"), root))
    parts = F.split("path", "/")
    kept = files.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, ignored))))
    skipped = F.col("length") > LARGEST
    return kept.select("path", F.when(~skipped, F.decode("content", "UTF-8")).alias("raw"), skipped.alias("skipped"))


def file_sets(spark: SparkSession, old: str, new: str, include: str = "*", exclude: str | None = None, by_name: bool = False) -> DataFrame:
    """(path, side) of the files of two folders, in lower case, side 0 being the old one; only metadata is read. exclude
    is a pattern of SQL's LIKE over the path."""
    out = None
    for side, root in enumerate((old, new)):
        path = F.lower(relative(F.col("path"), root))
        one = _files(spark, root, include).select((F.substring_index(path, "/", -1) if by_name else path).alias("path"), F.lit(side).alias("side"))
        out = one if out is None else out.unionByName(one)
    return out if exclude is None else out.where(~F.col("path").like(exclude.lower()))
