"""Storage that the driver and all executors see: qualified addresses, open files, and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, uri: str) -> str:
    """uri with its scheme: one without means the cluster's default file system, to Spark and to Python workers alike."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    text = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, _, rest = text.partition(":")
    return text if rest.startswith("//") else f"{scheme}://{rest}"


def file_system(uri: str):
    """The pyarrow file system of a URI and the path in it; plain paths are local. Paths are taken as they are, unescaped."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, mark, path = uri.partition("://")
    if not mark or scheme == "file":
        return fs.LocalFileSystem(), path if mark else uri
    return fs.FileSystem.from_uri(quote(uri, safe="/:@?&=+,;~"))


def open_uri(uri: str):
    """A seekable binary file of any store that pyarrow's file systems know."""
    store, path = file_system(uri)
    return store.open_input_file(path)


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, spark.checkpoint.dir; a temporary one only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        root = held or "file://" + tempfile.mkdtemp(prefix="shared-")
        if not held:
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_scopes[-1][0] if _scopes else shared_root(spark)}/{name}-{uuid.uuid4().hex}"


_scopes: list[tuple[str, list[str]]] = []


@contextmanager
def scope(spark: SparkSession, root: str | None = None) -> Iterator[None]:
    """Intermediate tables made inside go below root (or where they go anyway), and go away with the end of the block."""
    _scopes.append((root or (_scopes[-1][0] if _scopes else shared_root(spark)), []))
    try:
        yield
    finally:
        for uri in _scopes.pop()[1]:
            remove(spark, uri)


def keep(df: DataFrame) -> DataFrame:
    """A stored table outlives the scope that it was made in; a scope around that one, if any, takes it over."""
    if _scopes:
        _scopes[-1][1].remove(df.stored_path)
        if len(_scopes) > 1:
            _scopes[-2][1].append(df.stored_path)
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in shared storage: cuts the lineage, and a lost executor costs one task's reread."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    if _scopes:
        _scopes[-1][1].append(path)
    return out


def discard(df: DataFrame) -> None:
    """Removes what stored() wrote, once nothing reads it any more."""
    for _, held in _scopes:
        if df.stored_path in held:
            held.remove(df.stored_path)
    remove(df.sparkSession, df.stored_path)


def remove(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
