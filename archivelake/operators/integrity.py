"""Checksums of contents against those of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checksums import crc32c_of
from . import stats


def checksums(contents: DataFrame) -> DataFrame:
    """path and crc32c of contents (path, content), computed where they are read."""
    return contents.select("path", crc32c_of("content").alias("crc32c"))


def mismatches(contents: DataFrame) -> DataFrame:
    """path, crc32c, real of contents (path, content, crc32c) that differ; a file without a stored checksum is right."""
    real = contents.select("path", "crc32c", crc32c_of("content").alias("real"))
    return real.filter(F.col("crc32c").isNotNull() & ~F.col("crc32c").eqNullSafe(F.col("real")))


def problems(files: DataFrame, dirs: DataFrame, contents: DataFrame) -> DataFrame:
    """All that is wrong with an archive: problem, path."""
    return mismatches(contents).select(F.lit("checksum").alias("problem"), "path").unionByName(stats.index_problems(files, dirs))
