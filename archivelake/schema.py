"""The tables of an archive, and its errors."""

from __future__ import annotations

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

SCHEMA_VERSION = (0, 3)
#: No limit on a shard's size unless one is set.
NO_LIMIT = 2**63 - 1

_META = [StructField("mode", IntegerType()), StructField("uid", IntegerType()), StructField("gid", IntegerType()), StructField("mtime_ns", LongType())]
FILES = StructType(
    [StructField("path", StringType(), False), StructField("parent", StringType(), False), StructField("shard", IntegerType(), False), StructField("offset", LongType(), False), StructField("size", LongType()), StructField("crc32c", LongType()), *_META]
)
DIRS = StructType(
    [StructField("path", StringType(), False), StructField("parent", StringType()), StructField("num_subdirs", LongType()), StructField("num_files", LongType()), StructField("num_files_tree", LongType()), StructField("size_tree", LongType()), *_META]
)
CONFIG = StructType([StructField("key", StringType()), StructField("value_text", StringType()), StructField("value_int", LongType())])
FILE_COLUMNS, DIR_COLUMNS = FILES.fieldNames(), DIRS.fieldNames()


class ArchiveError(Exception):
    """Base of all errors below; not a LookupError, so the mapping interface translates where Python expects a KeyError."""


class EntryExists(ArchiveError):
    pass


class EntryNotFound(ArchiveError):
    pass


class DirectoryNotEmpty(ArchiveError):
    pass


class IsADirectory(ArchiveError):
    pass


class NotADirectory(ArchiveError):
    pass


class IntegrityError(ArchiveError):
    pass


class MergeConflict(ArchiveError, ValueError):
    pass


class NotEnoughSpace(ArchiveError):
    pass


class FileTooLarge(ArchiveError, ValueError):
    pass
