"""What the text operators share: input tables, shared storage, size-checked broadcasts, row keys."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stores import discard, keep, new_path, scope, shared_root, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts that are worked on at once. Spark bounds the batches that it hands over by bytes (64 MB by default); what Python makes
#: of them is bounded by working on slices.
TEXT_ROWS = 512


def pieces(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


#: Bytes of rows that Spark hands to Python at once in a frame of in_small_batches().
BATCH_BYTES = 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df in a session of its own, in which it and all that is derived from it go to Python BATCH_BYTES at a time (Spark's default
    of 64 MB is held several times, by the JVM outside its heap and by the worker). The settings of df's session, all of which
    hold there too, stay as they are."""
    spark = df.sparkSession
    own = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(min(BATCH_BYTES, int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()))))
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed()), own)


def trim() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


_slot: dict = {"owner": None, "value": None}


def held(owner: str, make=None):
    """What a Python worker keeps between its tasks, such as caches: one operator's at a time. Workers are used again by later
    stages, so when another operator's task starts, what the one before it kept goes back to the system."""
    if _slot["owner"] != owner:
        _slot.update(owner=owner, value=None)
        trim()
        _slot["value"] = make() if make else None
    return _slot["value"]


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of keys, the same in every run: that of the lowest hash of all columns."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*[F.col(c) for c in df.columns]))
    return df.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") == 1).drop("__place")


#: Rows up to which a side with a few dozen bytes a row is sent to every executor.
BROADCAST_ROWS = 50_000


def joinable(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint if a count shows it to be small enough; beyond that Spark shuffles it."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small
