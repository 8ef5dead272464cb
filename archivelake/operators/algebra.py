"""Changes of an archive as transformations of its tables: each takes tables and returns new ones.

Directories' counts follow from files, so the operators here leave them to ``stats.complete_dirs`` when a snapshot is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import globs, paths
from ..schema import NO_LIMIT, DirectoryNotEmpty, EntryExists, EntryNotFound, FileTooLarge, IsADirectory, MergeConflict, NotADirectory
from . import layout, stats


def conflicts(source_files: DataFrame, source_dirs: DataFrame, files: DataFrame, dirs: DataFrame, prefix: str = "") -> DataFrame:
    """kind and path of what keeps a source from being merged: a file where the other side has a directory, and a prefix that
    is a file or lies below one."""
    moved = paths.with_prefix(F.col("path"), prefix).alias("path")
    a = source_files.select(moved).join(dirs.select("path"), "path", "left_semi").select(F.lit("file over directory").alias("kind"), "path")
    b = source_dirs.select(moved).filter("path <> ''").join(files.select("path"), "path", "left_semi").select(F.lit("directory over file").alias("kind"), "path")
    above = paths.ancestors_of(paths.normalize(prefix))[1:] if prefix else []
    c = files.filter(F.col("path").isin(above)).select(F.lit("file over prefix").alias("kind"), "path")
    return a.unionByName(b).unionByName(c)


def check_conflicts(source_files: DataFrame, source_dirs: DataFrame, files: DataFrame, dirs: DataFrame, prefix: str = "") -> None:
    """An action: fails if a source can't be merged."""
    if row := conflicts(source_files, source_dirs, files, dirs, prefix).orderBy("kind", "path").first():
        raise MergeConflict(f"{row[0]}: {row[1]}")


def check_new(files: DataFrame, dirs: DataFrame, new: DataFrame, exist_ok: bool = False, limit: int = NO_LIMIT) -> DataFrame:
    """An action: fails if new files (path, and size where there is a limit) clash with each other or with what is there, or are
    too large; returns those that are new. All is looked for in one job."""
    at = new.select("path")
    above = new.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    found = {EntryExists: [stats.repeated_paths(at)], IsADirectory: [at.join(dirs.select("path"), "path", "left_semi")], NotADirectory: [above.join(files.select("path"), "path", "left_semi")]}
    if not exist_ok:
        found[EntryExists].append(at.join(files.select("path"), "path", "left_semi"))
    if limit < NO_LIMIT:
        found[FileTooLarge] = [new.filter(F.col("size") > limit).select("path")]
    kinds = list(found)
    wrong = None
    for k, kind in enumerate(kinds):
        for rows in found[kind]:
            rows = rows.select(F.lit(k).alias("kind"), "path")
            wrong = rows if wrong is None else wrong.unionByName(rows)
    first = wrong.agg(F.min(F.struct("kind", "path"))).first()[0]
    if first is not None:
        raise kinds[first["kind"]](first["path"])
    return new.join(files.select("path"), "path", "left_anti")


def keep_first(rows: DataFrame, rank: list[Column], key: str = "path") -> DataFrame:
    """Of rows with the same key, the first by rank; which one it is never depends on how rows are dealt."""
    by = Window.partitionBy(key).orderBy(*rank)
    return rows.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    out = rows.withColumn("path", paths.with_prefix(F.col("path"), prefix))
    return out.withColumn("parent", paths.parent(F.col("path"))) if "parent" in rows.columns else out


def merge_files(files: DataFrame, source: DataFrame, limit: int, prefix: str = "", ignore_duplicates: bool = False) -> DataFrame:
    """files and those of source behind them. Paths that both have are an error, or the target's stay if duplicates are
    ignored. Of rows of source with one path the first by address stays."""
    source = keep_first(prefixed(source, prefix), [F.col("shard"), F.col("offset")])
    if not ignore_duplicates and (row := source.join(files.select("path"), "path", "left_semi").first()):
        raise EntryExists(row["path"])
    return files.unionByName(layout.append(files, source.join(files.select("path"), "path", "left_anti"), limit).select(*files.columns))


def merge_indexes(files: DataFrame, source: DataFrame, prefix: str = "", ignore_duplicates: bool = True) -> DataFrame:
    """files and those of source, whose shards are numbered on and not copied. Of paths that both have, the target's stays; with
    ignore_duplicates off they are an error (then an action)."""
    if not ignore_duplicates and (row := prefixed(source.select("path"), prefix).join(files.select("path"), "path", "left_semi").first()):
        raise EntryExists(row[0])
    used = files.agg(F.coalesce(F.max("shard"), F.lit(-1)).alias("_used"))
    moved = prefixed(source, prefix).crossJoin(F.broadcast(used))  # one row
    moved = moved.withColumn("shard", (F.col("shard") + F.col("_used") + 1).cast("int")).drop("_used")
    return files.unionByName(moved.join(files.select("path"), "path", "left_anti").select(*files.columns))


def merge_dirs(dirs: DataFrame, source: DataFrame, prefix: str = "") -> DataFrame:
    """Directories of both: counts are added, modes joined bit by bit, the source's owner wins, the later time stays."""
    source = prefixed(source, prefix)
    both = dirs.alias("t").join(source.alias("s"), "path", "full")
    t, s = lambda c: F.col(f"t.{c}"), lambda c: F.col(f"s.{c}")
    total = lambda c: (F.coalesce(t(c), F.lit(0)) + F.coalesce(s(c), F.lit(0))).cast("long").alias(c)
    return both.select(
        "path",
        paths.parent(F.col("path")).alias("parent"),
        *[total(c) for c in stats.STATS],
        F.coalesce(t("mode").bitwiseOR(s("mode")), t("mode"), s("mode")).alias("mode"),
        F.coalesce(s("uid"), t("uid")).alias("uid"),
        F.coalesce(s("gid"), t("gid")).alias("gid"),
        F.greatest(t("mtime_ns"), s("mtime_ns")).alias("mtime_ns"),
    ).select(*dirs.columns)


def subset(files: DataFrame, limit: int, pattern: str | None = None, rules: list[tuple[bool, str]] | None = None, default: bool = True) -> DataFrame:
    """The files that match, laid out anew in address order. Directories follow from them."""
    at = F.col("path")
    where = globs.matches(at, pattern, recursive=True, include_hidden=True) if pattern is not None else globs.first_match(at, rules or [], default)
    placed = layout.place(files.filter(where), limit, ["shard", "offset", "size"])
    return placed.withColumns({"shard": F.col("new_shard").cast("int"), "offset": F.col("new_offset")}).select(*files.columns)


def remove(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows without the paths of gone; paths that are not there are passed over."""
    return rows.join(gone.select("path"), "path", "left_anti")


def remove_tree(rows: DataFrame, root: str) -> DataFrame:
    root = paths.normalize(root)
    if root == "":
        raise ValueError("the root can't be removed")
    return rows.filter(~paths.in_subtree(F.col("path"), root))


def remove_dir(dirs: DataFrame, path: str) -> DataFrame:
    """An action: only an empty directory goes."""
    path = paths.normalize(path)
    row = dirs.filter(F.col("path") == path).select("num_files", "num_subdirs").first()
    if row is None:
        raise EntryNotFound(path)
    if row[0] or row[1]:
        raise DirectoryNotEmpty(path)
    return dirs.filter(F.col("path") != path)


def rename(rows: DataFrame, old: str, new: str) -> DataFrame:
    """A file, or a directory with all below it, under another path."""
    old, new = paths.normalize(old), paths.normalize(new)
    if new == old or new.startswith(old + "/") or old == "":
        raise ValueError(f"can't rename {old!r} to {new!r}")
    out = rows.withColumn("path", paths.moved(F.col("path"), old, new))
    return out.withColumn("parent", paths.parent(F.col("path"))) if "parent" in rows.columns else out


def update(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows with the columns of changes (path and any others) where these are not null."""
    columns = [c for c in changes.columns if c != "path"]
    new = changes.select("path", *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(new, "path", "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*rows.columns)


def set_meta(rows: DataFrame, path: str, **values: int) -> DataFrame:
    """chmod, chown, touch."""
    hit = F.col("path") == paths.normalize(path)
    return rows.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)).cast(rows.schema[c].dataType) for c, v in values.items() if v is not None})
