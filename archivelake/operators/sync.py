"""Synchronising two trees: one full join of their listings decides for every path."""

from __future__ import annotations

import os.path
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import globs, paths


@dataclass
class Options:
    delete: bool = False
    checksum: bool = False
    size_only: bool = False
    update: bool = False
    existing: bool = False
    ignore_existing: bool = False
    min_size: int | None = None
    max_size: int | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


def actions(source: DataFrame, target: DataFrame, options: Options | None = None, prefix: str = "") -> DataFrame:
    """path, action (add, update, skip, exclude, delete, keep) and both sizes and times. Rules hold in this order: names that are
    excluded, sizes out of bounds, only existing, no existing, newer in the target, then what tells files apart: checksums, sizes,
    or sizes and times. With delete, what stands below prefix in the target and not in the unfiltered source goes; an excluded
    name that the source has stays."""
    o = options or Options()
    columns = ["size", "mtime_ns", *(["crc32c"] if o.checksum else [])]
    side = lambda rows, name: rows.select("path", *[F.col(c).alias(f"{name}_{c}") for c in columns], F.lit(True).alias(f"in_{name}"))
    if prefix:
        source = source.withColumn("path", paths.with_prefix(F.col("path"), prefix))
    both = side(source, "source").join(side(target, "target"), "path", "full")
    here, there = F.col("in_source").isNotNull(), F.col("in_target").isNotNull()
    gone = F.lit("delete") if o.delete else F.lit("keep")
    action = F.when(~here, F.when(paths.in_subtree(F.col("path"), paths.normalize(prefix) if prefix else ""), gone).otherwise("keep"))
    action = action.when(~globs.sync_filter(F.col("path"), o.include, o.exclude), "exclude")
    if o.min_size is not None:
        action = action.when(F.col("source_size") < o.min_size, "skip")
    if o.max_size is not None:
        action = action.when(F.col("source_size") > o.max_size, "skip")
    if o.existing:
        action = action.when(~there, "skip")
    if o.ignore_existing:
        action = action.when(there, "skip")
    action = action.when(~there, "add")
    if o.update:
        action = action.when(F.col("target_mtime_ns") >= F.col("source_mtime_ns"), "skip")
    if o.checksum:
        same = F.col("source_crc32c").eqNullSafe(F.col("target_crc32c")) & (F.col("source_size") == F.col("target_size"))
    elif o.size_only:
        same = F.col("source_size") == F.col("target_size")
    else:
        same = (F.col("source_size") == F.col("target_size")) & F.col("source_mtime_ns").eqNullSafe(F.col("target_mtime_ns"))
    return both.select("path", action.when(same, "skip").otherwise("update").alias("action"), *[f"{s}_{c}" for s in ("source", "target") for c in ("size", "mtime_ns")])


def to_delete(source: DataFrame, target: DataFrame, prefix: str = "") -> DataFrame:
    rows = target.filter(paths.in_subtree(F.col("path"), paths.normalize(prefix) if prefix else "")).select("path")
    return rows.join(source.select(paths.with_prefix(F.col("path"), prefix).alias("path")), "path", "left_anti")


@dataclass(frozen=True)
class Endpoint:
    """Where one side of a synchronisation lies: a folder, or an archive with a path in it. contents: a trailing slash was given,
    so what is below is meant, not the folder itself."""

    location: str
    inner: str | None
    contents: bool

    @property
    def kind(self) -> str:
        if self.inner is not None:
            return "archive"
        name = self.location.lower()
        return "packed" if name.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz", ".zip")) else "folder"


def endpoint(text: str) -> Endpoint:
    """``archive::path``; a backslash before :: keeps it as it is."""
    marked = text.replace("\\::", "\0")
    location, mark, inner = marked.partition("::")
    inner = inner.replace("\0", "::") if mark else None
    location = location.replace("\0", "::")
    return Endpoint(location.rstrip("/") or "/", paths.normalize(inner) if inner else inner, (inner if inner is not None else location).endswith("/") or inner == "")


def subdirectory(name: str) -> str:
    """The folder that an archive is merged into when each gets its own: its name in lower case without the ending."""
    name = os.path.basename(name.rstrip("/")).lower()
    for end in (".tar.gz", ".tar.bz2", ".tar.xz", ".tgz", ".tar", ".zip", ".archive"):
        if name.endswith(end):
            return name.removesuffix(end)
    return name
