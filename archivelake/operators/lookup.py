"""Scans, lookups and membership over the tables files and dirs. All are lazy unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import DIR_COLUMNS, FILE_COLUMNS, EntryNotFound

#: Orders of a listing. 'any' and 'desc' alone mean none.
ORDERS = {"any": [], "path": ["path"], "address": ["shard", "offset"], "random": []}


def ordered(rows: DataFrame, order: str = "any", descending: bool = False, seed: int = 0) -> DataFrame:
    if order == "random":
        return rows.orderBy(F.rand(seed))
    columns = ORDERS[order]
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"order {order!r} needs columns {missing}")
    return rows.orderBy(*[F.col(c).desc() if descending else F.col(c) for c in columns]) if columns else rows


def scan_files(files: DataFrame, order: str = "any", descending: bool = False) -> DataFrame:
    return ordered(files.select(*FILE_COLUMNS), order, descending)


def scan_dirs(dirs: DataFrame, order: str = "any", descending: bool = False) -> DataFrame:
    if order == "address":
        raise ValueError("directories have no address")
    return ordered(dirs.select(*DIR_COLUMNS), order, descending)


def entries(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Both kinds as one table: type is 'd' or 'f', a directory's size is that of its tree."""
    d = dirs.select(F.lit("d").alias("type"), "path", "parent", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("offset"), F.col("size_tree").alias("size"), F.lit(None).cast("long").alias("crc32c"), "mode", "uid", "gid", "mtime_ns", "num_subdirs", "num_files", "num_files_tree")
    f = files.select(F.lit("f").alias("type"), "path", "parent", "shard", "offset", "size", "crc32c", "mode", "uid", "gid", "mtime_ns")
    return d.unionByName(f, allowMissingColumns=True)


def all_paths(files: DataFrame, dirs: DataFrame) -> DataFrame:
    return dirs.select("path").union(files.select("path"))


def totals(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """num_files, num_dirs (the root included), total_size."""
    f = files.agg(F.count("*").alias("num_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))
    return f.crossJoin(dirs.agg(F.count("*").alias("num_dirs")))  # one row each


def lookup(rows: DataFrame, path: str) -> DataFrame:
    return rows.filter(F.col("path") == paths.normalize(path))


def lookup_many(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, path) with the files' columns, in the order of pos and with its repetitions; what is missing has a null
    size. ``require_all`` turns that into an error."""
    return wanted.select("pos", "path").join(files, "path", "left").orderBy("pos")


def require_all(found: DataFrame) -> DataFrame:
    """An action: fails if a path was not found."""
    missing = found.filter(F.col("shard").isNull()).select("path").first()
    if missing:
        raise EntryNotFound(missing[0])
    return found


def exists(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (path) that are there."""
    return wanted.join(rows.select("path"), "path", "left_semi")


def membership(wanted: DataFrame, files: DataFrame, dirs: DataFrame) -> DataFrame:
    """path, is_file, is_dir of each row of wanted."""
    kinds = files.select("path", F.lit(True).alias("is_file")).unionByName(dirs.select("path", F.lit(True).alias("is_dir")), allowMissingColumns=True)
    kinds = wanted.select("path").distinct().join(kinds, "path", "left").groupBy("path").agg(F.coalesce(F.bool_or("is_file"), F.lit(False)).alias("is_file"), F.coalesce(F.bool_or("is_dir"), F.lit(False)).alias("is_dir"))
    return wanted.select("path").join(kinds, "path")


def last_file(files: DataFrame) -> DataFrame:
    """The file at the highest address; ties of empty files go to the higher path."""
    return files.orderBy(F.desc("shard"), F.desc("offset"), F.desc("size"), F.desc("path")).limit(1)


def shard_ends(files: DataFrame) -> DataFrame:
    return files.groupBy("shard").agg(F.max(F.col("offset") + F.col("size")).alias("logical_end"))


def used_shards(files: DataFrame) -> DataFrame:
    return files.agg((F.coalesce(F.max("shard"), F.lit(-1)) + 1).cast("long").alias("num_used_shards"))


def depths(rows: DataFrame) -> DataFrame:
    return rows.groupBy(paths.depth(F.col("path")).alias("depth")).agg(F.count("*").alias("n"))


def find(both: DataFrame, root: str = "", name: str | None = None, path: str | None = None, kind: str | None = None, size: str | None = None, maxdepth: int | None = None) -> DataFrame:
    """Entries that meet all conditions; the root shows as '.'."""
    from ..functions import formatting, globs

    at, root = F.col("path"), paths.normalize(root) if root else ""
    where: Column = paths.in_subtree(at, root)
    if maxdepth is not None:
        where = where & (paths.depth(at) <= maxdepth + (root.count("/") + 1 if root else 0))
    if name is not None:
        where = where & globs.matches_name(at, name)
    if path is not None:
        where = where & globs.matches_raw(at, path)
    if kind is not None:
        where = where & (F.col("type") == kind)
    if size is not None:
        where = where & formatting.size_condition(F.col("size"), size)
    return both.filter(where).withColumn("shown", F.when(at == "", ".").otherwise(at))
