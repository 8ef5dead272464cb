"""Continuous intake, an addition of this engine: files that arrive in a folder, or rows of any stream, become archive entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths
from ..plans.archive import Archive


def arriving(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of path, content, mtime_ns of the files that appear in a folder."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    base = folder.partition("://")[2].lstrip("/") if "://" in folder else folder.strip("/")
    inner = F.ltrim(F.substr(F.regexp_replace("path", "^[a-z0-9+.-]+:/+", ""), F.lit(len(base) + 1)), F.lit("/"))
    return rows.select(inner.alias("path"), "content", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def ingest(rows: DataFrame, archive: Archive, checkpoint: str) -> StreamingQuery:
    """Adds a stream of files (path, content) in micro-batches; the first of a path stays. A batch that runs again after a failure
    finds its paths there and adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        first = batch.groupBy("path").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "path"]), F.xxhash64("content")).alias("_v")).select("path", "_v.*")
        if not first.isEmpty():
            archive.add(first, exist_ok=True)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_stats(rows: DataFrame) -> DataFrame:
    """num_files_tree and size_tree of each directory over a stream of (path, size) with signs (s): for output mode update."""
    up = rows.select(F.explode(paths.ancestors(F.col("path"))).alias("path"), "size", "s")
    return up.groupBy("path").agg(F.sum("s").alias("num_files_tree"), F.sum(F.col("s") * F.col("size")).alias("size_tree"))


def windowed_arrivals(rows: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Files and bytes by top directory and window of arrival (ts), with a bound for late rows."""
    rows = rows.withWatermark("ts", late).withColumn("top", F.substring_index("path", "/", 1))
    return rows.groupBy(F.window("ts", every), "top").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


__all__ = ["arriving", "ingest", "running_stats", "windowed_arrivals"]
