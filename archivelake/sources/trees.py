"""Folders of any file system as tables of entries."""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, paths
from ..functions.checksums import spans
from .stores import file_system, qualified

TREE = "type string, path string, size long, mode int, uid int, gid int, mtime_ns long"
#: Directories that the driver looks for before tasks walk on from them; bytes of contents in a batch.
SEEDS, BATCH_BYTES = 64, 4 << 20
#: Bytes and files of a task that reads or writes many files, at most, about.
SHARE, FILES = 32 << 20, 10_000


def tasks(spark: SparkSession, held: int, n: int) -> int:
    """Tasks for reading and writing n files of held bytes: enough for all cores, with shares that don't grow with the whole."""
    return max(4 * spark.sparkContext.defaultParallelism, held // SHARE + 1, n // FILES + 1)


def _listed(store, base: str, inner: str, local: bool) -> Iterator[tuple]:
    """Rows of TREE for what is right in a directory. Local files have their mode and owner; links to directories are passed over."""
    at = f"{base}/{inner}" if inner else base
    if local:
        with os.scandir(at) as found:
            for x in found:
                kind = "d" if x.is_dir(follow_symlinks=False) else "f" if x.is_file() else None
                if kind:
                    s = x.stat()
                    yield kind, f"{inner}/{x.name}" if inner else x.name, s.st_size if kind == "f" else None, s.st_mode, s.st_uid, s.st_gid, s.st_mtime_ns
        return
    from pyarrow import fs

    for x in store.get_file_info(fs.FileSelector(at)):
        if x.type in (fs.FileType.File, fs.FileType.Directory):
            kind = "f" if x.type == fs.FileType.File else "d"
            yield kind, f"{inner}/{x.base_name}" if inner else x.base_name, x.size if kind == "f" else None, stat.S_IFREG | 0o644 if kind == "f" else stat.S_IFDIR | 0o755, None, None, x.mtime_ns


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """type ('f' or 'd'), path (relative to root), size, mode, uid, gid, mtime_ns of all below a folder, empty files and empty
    directories included. The driver looks for some directories to start from; tasks list those and walk on."""
    root = qualified(spark, root)
    store, base = file_system(root)
    local = root.startswith("file:")
    base = base.rstrip("/") or "/"
    seeds, queue = [], [""]
    while queue and len(queue) < SEEDS and len(seeds) < SEEDS:
        inner = queue.pop(0)
        seeds.append((inner, False))
        queue.extend(x[1] for x in _listed(store, base, inner, local) if x[0] == "d")
    seeds += [(x, True) for x in queue]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(root)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in TREE.split(", ")])
        rows = []
        for batch in batches:
            for inner, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stack = [inner]
                while stack:
                    for x in _listed(store, base, stack.pop(), local):
                        rows.append(x)
                        if deep and x[0] == "d":
                            stack.append(x[1])
                        if len(rows) >= 5000:
                            yield batch_of(rows)
                            rows = []
        if rows:
            yield batch_of(rows)

    starts = spark.createDataFrame(seeds, "inner string, deep boolean").repartition(min(len(seeds), SEEDS), "inner")
    return starts.mapInArrow(walk, TREE)


def reader(names: list[str], root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does to batches of rows with these columns (path, relative to root, and others) to add content, a few MB of it
    in a batch; root is qualified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(root)
        for batch in batches:
            begin, held, contents = 0, 0, []
            for i, path in enumerate(batch.column(names.index("path")).to_pylist()):
                with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                    contents.append(f.read())
                held += len(contents[-1])
                if held >= BATCH_BYTES or i + 1 == len(batch):
                    out = pa.RecordBatch.from_arrays([*batch.slice(begin, i + 1 - begin).columns, pa.array(contents, pa.binary())], [*names, "content"])
                    begin, held, contents = i + 1, 0, []
                    yield out

    return read


def with_content(files: DataFrame, root: str) -> DataFrame:
    """files (path, relative to root, and any others) with content, read where the rows are."""
    schema = files.withColumn("content", F.lit(None).cast("binary")).schema
    return files.mapInArrow(reader(files.columns, qualified(files.sparkSession, root)), schema)


def read_folder(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, content: bool = True) -> DataFrame:
    """path (relative to root), parent, size, mode, uid, gid, mtime_ns (and content) of the files below a folder."""
    rows = read_tree(spark, root).filter("type = 'f'").filter(globs.build_filter(F.col("path"), include or [], exclude or []))
    rows = rows.select("path", paths.parent(F.col("path")).alias("parent"), "size", "mode", "uid", "gid", "mtime_ns")
    if not content:
        return rows
    # a number of its own keeps Spark from joining parts by the few bytes that rows have without their contents
    return with_content(rows.repartition(max(64, 4 * spark.sparkContext.defaultParallelism), "path"), root)


def read_list(spark: SparkSession, listing: str, separator: str = "\n") -> DataFrame:
    """path of each line (or part between separators, such as NUL) of a list of paths."""
    return spark.read.option("lineSep", separator).text(listing).filter("value <> ''").select(F.col("value").alias("path"))


def write_folder(contents: DataFrame, root: str, fetch: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Writes contents (path, content) below root on a store that all executors reach; path and size of what was written. A file
    appears whole or not at all. fetch, if given, adds content to batches of rows without it, in the tasks that write."""
    root = qualified(contents.sparkSession, root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = file_system(root)
        made = None
        for batch in fetch(batches) if fetch else batches:
            raw, begins, ends = spans(batch.column("content"))
            raw, written = memoryview(raw), batch.column("path").to_pylist()
            for path, begin, end in zip(written, begins.tolist(), ends.tolist()):
                inner = paths.normalize(path)
                if inner == ".." or inner.startswith("../"):
                    raise ValueError(f"{path!r} leaves the folder")
                name = f"{base}/{inner}"
                if (above := name.rpartition("/")[0]) != made:
                    store.create_dir(above, recursive=True)
                    made = above
                part = f"{name}.{TaskContext.get().taskAttemptId()}.part"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(raw[begin:end])
                store.move(part, name)
            batch = raw = None
            # paths as copies: a slice would hold all of the batch
            yield pa.RecordBatch.from_arrays([pa.array(written, pa.string()), pa.array(ends - begins)], ["path", "size"])

    return (contents if fetch else contents.select("path", "content")).mapInArrow(write, "path string, size long")


def write_index_csv(files: DataFrame, folder: str) -> None:
    """path, shard, offset, size, crc32c in path order, text in quotes (those in it doubled) and numbers not; the files of the
    folder follow each other."""
    quoted = F.concat(F.lit('"'), F.replace("path", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", quoted, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("shard", "offset", "size", "crc32c")])
    # a line is one column here, so Spark's own quoting has to stay out of it
    rows = files.orderBy("path").select(line.alias(",".join(f'"{c}"' for c in ("path", "shard", "offset", "size", "crc32c"))))
    rows.write.options(header=True, sep="\1", quote="\0", escapeQuotes=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).mode("overwrite").csv(folder)


def write_jsonl(both: DataFrame, folder: str) -> None:
    both.write.option("ignoreNullFields", False).mode("overwrite").json(folder)
