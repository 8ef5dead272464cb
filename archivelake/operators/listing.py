"""Listings, walks and reports over the directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formatting, globs, paths
from . import lookup


def direct(rows: DataFrame, directory: str) -> DataFrame:
    """The files, or the subdirectories, right below a directory."""
    return rows.filter(F.col("parent") == paths.normalize(directory)) if directory else rows.filter(F.col("parent") == "")


def names(files: DataFrame, dirs: DataFrame, directory: str) -> DataFrame:
    both = direct(dirs, directory).select("path").union(direct(files, directory).select("path"))
    return both.select(paths.basename(F.col("path")).alias("name"))


def scandir(files: DataFrame, dirs: DataFrame, directory: str) -> DataFrame:
    """Entries of a directory: subdirectories first, then files, each by name."""
    return direct(lookup.entries(files, dirs), directory).orderBy("type", "path")


def walk(files: DataFrame, dirs: DataFrame, root: str = "") -> DataFrame:
    """path, subdirs, files of each directory below root, in pre-order."""
    root = paths.normalize(root) if root else ""
    listed = lambda rows, name: rows.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("path")).agg(F.sort_array(F.collect_list(paths.basename(F.col("path")))).alias(name))
    none = F.array().cast("array<string>")
    out = dirs.filter(paths.in_subtree(F.col("path"), root)).select("path").join(listed(dirs, "subdirs"), "path", "left").join(listed(files, "files"), "path", "left")
    out = out.withColumns({"subdirs": F.coalesce("subdirs", none), "files": F.coalesce("files", none)})
    return out.orderBy(paths.tree_key(F.col("path")))


def tree(files: DataFrame, dirs: DataFrame, root: str = "", maxdepth: int | None = None, dirs_only: bool = False) -> DataFrame:
    """shown: a line of a tree report for each entry below root, in its order: directories before files, each by name."""
    root = paths.normalize(root) if root else ""
    both = dirs.select("path", "parent", F.lit("d").alias("type"))
    if not dirs_only:
        both = both.unionByName(files.select("path", "parent", F.lit("f").alias("type")))
    both = both.filter(paths.in_subtree(F.col("path"), root) & (F.col("path") != root)).withColumn("depth", paths.depth(F.col("path")) - (root.count("/") + 1 if root else 0))
    if maxdepth is not None:
        both = both.filter(F.col("depth") <= maxdepth)
    last = F.lead("path").over(Window.partitionBy("parent").orderBy("type", "path")).isNull()
    # names of directories sort before those of files at each level
    parts = F.split("path", "/")
    key = F.transform(parts, lambda x, i: F.concat(F.when((i == F.size(parts) - 1) & (F.col("type") == "f"), "1").otherwise("0"), x))
    lines = both.withColumn("shown", F.concat(F.repeat(F.lit("    "), F.col("depth") - 1), F.when(last, "└── ").otherwise("├── "), paths.basename(F.col("path"))))
    return lines.withColumn("key", key).orderBy("key").drop("key")


def disk_usage(files: DataFrame, dirs: DataFrame, root: str = "", all_files: bool = False, maxdepth: int | None = None) -> DataFrame:
    """path and size of each directory's tree (with all_files of each file too): deepest first, then by path."""
    root = paths.normalize(root) if root else ""
    rows = dirs.select("path", F.col("size_tree").alias("size"))
    if all_files:
        rows = rows.unionByName(files.select("path", "size"))
    at = F.col("path")
    rows = rows.filter(paths.in_subtree(at, root))
    if maxdepth is not None:
        rows = rows.filter(paths.depth(at) <= maxdepth + (root.count("/") + 1 if root else 0))
    return rows.orderBy(F.desc(F.length(at) - F.length(F.replace(at, F.lit("/")))), at)


def shares(files: DataFrame, dirs: DataFrame, directory: str = "") -> DataFrame:
    """What a disk-usage browser shows of a directory: name, type, size, share of the whole; largest first of each type."""
    rows = direct(lookup.entries(files, dirs), directory).select(paths.basename(F.col("path")).alias("name"), "type", "size")
    whole = F.sum("size").over(Window.partitionBy())
    return rows.withColumn("share", F.when(whole > 0, F.col("size") / whole)).orderBy("type", F.desc("size"), "name")


def sequences(files: DataFrame, directory: str | None = None, least: int = 5) -> DataFrame:
    """Runs of numbered names, such as frames: parent, pattern (a star for each digit of the number that varies most), n, first,
    last. Names in no run stand by themselves: the name as pattern, n = 1, no first and last.

    Names are alike if all but their digits is, and numbers at the same place have as many digits. Of the numbers in least alike
    names or more, the one with most distinct values is starred (the first of several); names that agree in all others form a
    run if they are least or more.
    """
    rows = files if directory is None else direct(files, directory)
    name = paths.basename(F.col("path"))
    rows = rows.select("parent", name.alias("name"), F.regexp_extract_all(name, F.lit("[0-9]+"), F.lit(0)).alias("numbers"), F.split(name, "[0-9]+").alias("texts"))
    rows = rows.withColumn("shape", F.to_json(F.struct("texts", F.transform("numbers", F.length).alias("widths"))))
    alike = ["parent", "shape"]
    each = rows.select(*alike, F.posexplode("numbers").alias("place", "number"))
    counts = each.groupBy(*alike, "place").agg(F.countDistinct("number").alias("kinds"), F.count("*").alias("n"))
    star = counts.groupBy(*alike).agg(F.min_by("place", F.struct(-F.col("kinds"), F.col("place"))).alias("star"), F.max("n").alias("n")).filter(F.col("n") >= least).drop("n")
    marked = rows.join(star, alike, "left").withColumn("value", F.get("numbers", F.col("star")))
    filled = F.transform("texts", lambda t, i: F.concat(t, F.when(i == F.col("star"), F.repeat(F.lit("*"), F.length("value"))).otherwise(F.coalesce(F.get("numbers", i), F.lit("")))))
    marked = marked.withColumn("pattern", F.when(F.col("star").isNotNull(), F.array_join(filled, "")))
    runs = marked.filter("pattern is not null").groupBy(*alike, "pattern").agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))
    single = lambda x: x.select("parent", F.col("name").alias("pattern"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"))
    short = marked.join(runs.filter(F.col("n") < least).select(*alike, "pattern"), [*alike, "pattern"], "left_semi")
    return runs.filter(F.col("n") >= least).drop("shape").unionByName(single(short)).unionByName(single(marked.filter("pattern is null")))


def long_listing(both: DataFrame) -> DataFrame:
    """Columns of ``ls -l``: mode, uid, gid, size, modified, path."""
    return both.select(formatting.mode_string(F.col("mode"), F.col("type") == "d").alias("mode"), "uid", "gid", formatting.human_size(F.col("size")).alias("size"), formatting.modified(F.col("mtime_ns")).alias("modified"), "path")


def complete(files: DataFrame, dirs: DataFrame, start: str, most: int = 200) -> DataFrame:
    """Entries of start's directory whose paths begin with start; at most `most`, which is the feature."""
    head = start.rpartition("/")[0]
    return direct(lookup.entries(files, dirs), head).filter(F.col("path").startswith(start)).select("path").orderBy("path").limit(most)


def json_tree(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """parent and children (JSON objects by name): the rows from which a nested usage report is put together."""
    child = F.to_json(F.struct(paths.basename(F.col("path")).alias("name"), F.col("size").alias("asize"), "type"))
    rows = lookup.entries(files, dirs).filter(F.col("parent").isNotNull()).select("parent", "path", child.alias("child"))
    return rows.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "child"))), lambda x: x["child"]).alias("children"))


def glob_paths(files: DataFrame, dirs: DataFrame, pattern: str, recursive: bool = False, include_hidden: bool = False, only_files: bool = False) -> DataFrame:
    """path of what matches. ``d/**`` gives d itself as 'd/', as Python does; ``**`` gives the root as ''."""
    at = F.col("path")
    rows = files.select("path") if only_files else lookup.all_paths(files, dirs)
    found = rows.filter(globs.matches(at, pattern, recursive, include_hidden))
    if not only_files and recursive and pattern.endswith("/**") and not globs._MAGIC.search(pattern[:-3]):
        found = found.union(dirs.filter(at == pattern[:-3]).select(F.concat("path", F.lit("/")).alias("path")))
    return found


def glob_entries(files: DataFrame, dirs: DataFrame, pattern: str, recursive: bool = False, include_hidden: bool = False, only_files: bool = False) -> DataFrame:
    rows = files if only_files else lookup.entries(files, dirs)
    return rows.filter(globs.matches(F.col("path"), pattern, recursive, include_hidden))
