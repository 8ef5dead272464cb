"""Path expressions, as Columns that stay in generated code, and the same rules for single Python strings."""

from __future__ import annotations

import os.path

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: str) -> str:
    """The stored form of a path: no leading slash, no dots; the root is ''."""
    path = os.path.normpath(path).lstrip("/")
    return "" if path == "." else path


def parent_of(path: str) -> str | None:
    return None if path == "" else path.rpartition("/")[0]


def ancestors_of(path: str) -> list[str]:
    """From the root to the path itself."""
    parts = path.split("/") if path else []
    return ["/".join(parts[:i]) for i in range(len(parts) + 1)]


def parent(path: Column) -> Column:
    """'' for entries of the root; null for the root itself."""
    return F.when(path != "", F.regexp_replace(path, "/?[^/]*$", ""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """In lower case with its dot; '' for none. A leading dot is part of the name."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def depth(path: Column) -> Column:
    """The root has depth 0."""
    return (F.length(path) - F.length(F.replace(path, F.lit("/"))) + (path != "").cast("int")).cast("int")


def ancestors(path: Column) -> Column:
    """The directories above an entry, from the root on."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def in_subtree(path: Column, root: str) -> Column:
    """The entry itself or anything below it; both parts reach the Parquet scan."""
    return F.lit(True) if root == "" else (path == root) | path.startswith(root + "/")


def tree_key(path: Column) -> Column:
    """Sorts entries in pre-order: byte order alone would put 'a.b' between 'a' and 'a/b'."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


def with_prefix(path: Column, prefix: str) -> Column:
    prefix = normalize(prefix) if prefix else ""
    if prefix == "":
        return path
    return F.when(path == "", F.lit(prefix)).otherwise(F.concat(F.lit(prefix + "/"), path))


def moved(path: Column, old: str, new: str) -> Column:
    """path with the subtree old renamed to new."""
    below = F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))
    return F.when(path == old, F.lit(new)).when(path.startswith(old + "/"), below).otherwise(path)
