"""Roll-ups over the directory tree: recomputed, kept up by differences, and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import DIR_COLUMNS

STATS = ["num_subdirs", "num_files", "num_files_tree", "size_tree"]


def tree_stats(files: DataFrame) -> DataFrame:
    """path, num_files_tree, size_tree of each directory above a file. Each file goes to its ancestors and is summed in the
    same task first, so what is shuffled grows with the directories."""
    up = files.select(F.explode(paths.ancestors(F.col("path"))).alias("dir"), "size")
    return up.groupBy(F.col("dir").alias("path")).agg(F.count("*").alias("num_files_tree"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size_tree"))


def direct_counts(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """path, num_files, num_subdirs of the directories that have any: one pass over both tables."""
    one = files.select(F.col("parent").alias("path"), F.lit(1).alias("f"), F.lit(0).alias("d")).unionByName(dirs.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("path"), F.lit(0).alias("f"), F.lit(1).alias("d")))
    return one.groupBy("path").agg(F.sum("f").alias("num_files"), F.sum("d").alias("num_subdirs"))


def close_dirs(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path of all directories that files and known ones need, the root included."""
    rows = files.select(F.explode(paths.ancestors(F.col("path"))).alias("path"))
    if known is not None:
        rows = rows.unionByName(known.filter(F.col("path") != "").select(F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("path")))
    return rows.unionByName(files.sparkSession.createDataFrame([("",)], "path string")).distinct()


def complete_dirs(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The table dirs for files: known directories keep their metadata, missing ones are added, all counts are recomputed."""
    made = close_dirs(files, known)
    meta = ["mode", "uid", "gid", "mtime_ns"]
    if known is not None:
        made = made.join(known.select("path", *meta), "path", "left")
    else:
        made = made.select("path", *[F.lit(None).cast("long" if c == "mtime_ns" else "int").alias(c) for c in meta])
    made = made.withColumn("parent", paths.parent(F.col("path")))
    out = made.join(direct_counts(files, made), "path", "left").join(tree_stats(files), "path", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in STATS}).select(*DIR_COLUMNS)


def apply_changes(dirs: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """dirs after files (path, size) were added and removed: signed rows climb to the ancestors and are added to the counts. A
    file that grew is removed with its old size and added with its new one. Directories that are new get rows."""
    signed = added.select("path", "size", F.lit(1).alias("s")).unionByName(removed.select("path", "size", F.lit(-1).alias("s")))
    up = signed.select(F.posexplode(F.reverse(paths.ancestors(F.col("path")))).alias("above", "dir"), "size", "s")
    delta = up.groupBy(F.col("dir").alias("path")).agg(F.sum("s").alias("files"), F.sum(F.col("s") * F.col("size")).alias("bytes"), F.sum(F.when(F.col("above") == 0, F.col("s")).otherwise(0)).alias("here"))
    new = delta.join(dirs.select("path"), "path", "left_anti").select("path")
    subdirs = new.filter(F.col("path") != "").groupBy(paths.parent(F.col("path")).alias("path")).agg(F.count("*").alias("more"))
    rows = dirs.unionByName(new.withColumn("parent", paths.parent(F.col("path"))), allowMissingColumns=True)
    rows = rows.join(delta, "path", "left").join(subdirs, "path", "left")
    plus = lambda c, d: (F.coalesce(c, F.lit(0)) + F.coalesce(d, F.lit(0))).cast("long")
    return rows.withColumns({"num_files_tree": plus("num_files_tree", "files"), "size_tree": plus("size_tree", "bytes"), "num_files": plus("num_files", "here"), "num_subdirs": plus("num_subdirs", "more")}).select(*dirs.columns)


def stale_stats(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Directories whose stored counts differ from recomputed ones: path, and both values of each."""
    fresh = complete_dirs(files, dirs).select("path", *[F.col(c).alias(f"real_{c}") for c in STATS])
    both = dirs.select("path", *STATS).join(fresh, "path")
    differs = ~F.col(STATS[0]).eqNullSafe(F.col(f"real_{STATS[0]}"))
    for c in STATS[1:]:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"real_{c}"))
    return both.filter(differs)


def orphans(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Entries whose parent is no directory."""
    known = dirs.select(F.col("path").alias("parent"))
    return files.select("path", "parent").unionByName(dirs.filter(F.col("parent").isNotNull()).select("path", "parent")).join(known, "parent", "left_anti").select("path")


def clashes(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Paths that are a file and a directory."""
    return files.select("path").join(dirs.select("path"), "path", "left_semi")


def repeated_paths(files: DataFrame) -> DataFrame:
    return files.groupBy("path").count().filter("count > 1").select("path")


def index_problems(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """problem and path of whatever is wrong with the index; no rows if nothing is."""
    parts = [("stale counts", stale_stats(files, dirs)), ("no parent", orphans(files, dirs)), ("file and directory", clashes(files, dirs)), ("path twice", repeated_paths(files))]
    out = None
    for name, rows in parts:
        rows = rows.select(F.lit(name).alias("problem"), "path")
        out = rows if out is None else out.unionByName(rows)
    return out


def affected(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of dirs above any of files: what a partial recomputation has to touch."""
    return dirs.join(files.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct(), "path", "left_semi")
