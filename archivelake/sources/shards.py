"""The blob plane: bytes of shards, read by address on the executors.

Shards are plain concatenations named ``<root>-shard-NNNNN`` (or any URIs that a shard map gives). Files are grouped into tasks
by ranges of addresses, so a shard is read front to back and neighbours are one read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checksums import crc32c_array, crc32c_spans, spans
from ..schema import IntegrityError
from .stores import file_system, open_uri, qualified

#: Bytes between two files up to which both are fetched in one read; bytes of contents in a batch.
JOIN_BYTES, BATCH_BYTES = 64 << 10, 4 << 20


def shard_uri(root: str, shard: int) -> str:
    return f"{root}-shard-{shard:05d}"


def reader(names: list[str], root: str, uris: dict[int, str] | None = None, check: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does to batches of rows with these columns to add content, a few MB of it in a batch; root is qualified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, handle = None, None  # one shard at a time: rows come by address
        for batch in batches:
            shard, offset, size = (batch.column(names.index(c)).to_pylist() for c in ("shard", "offset", "size"))
            crc = batch.column(names.index("crc32c")).to_pylist() if "crc32c" in names else [None] * len(batch)
            begin, held, contents = 0, 0, []
            at = 0
            while at < len(batch):
                end, stop = at + 1, offset[at] + (size[at] or 0)
                while end < len(batch) and shard[end] == shard[at] and 0 <= offset[end] - stop <= JOIN_BYTES and offset[end] + (size[end] or 0) - offset[at] <= BATCH_BYTES:
                    stop = offset[end] + (size[end] or 0)
                    end += 1
                if shard[at] != opened:
                    if handle is not None:
                        handle.close()
                    opened, handle = shard[at], open_uri((uris or {}).get(shard[at]) or shard_uri(root, shard[at]))
                handle.seek(offset[at])
                raw = handle.read(stop - offset[at])  # no memoryview: pyarrow never frees those in an array
                for i in range(at, end):
                    contents.append(raw[offset[i] - offset[at] : offset[i] - offset[at] + (size[i] or 0)])
                held, at = held + len(raw), end
                if held >= BATCH_BYTES or at == len(batch):
                    found = pa.array(contents, pa.binary())
                    if check:
                        for i, real in enumerate(crc32c_array(found).to_pylist()):
                            if crc[begin + i] is not None and crc[begin + i] != real or len(contents[i]) != (size[begin + i] or 0):
                                raise IntegrityError(f"row {begin + i}: checksum or size differs")
                    out = pa.RecordBatch.from_arrays([*batch.slice(begin, at - begin).columns, found], [*names, "content"])
                    begin, held, contents, raw, found = at, 0, [], None, None
                    yield out
        if handle is not None:
            handle.close()

    return read


def read_contents(files: DataFrame, root: str, uris: dict[int, str] | None = None, check: bool = True) -> DataFrame:
    """files with content, by address in each partition. With check, a file whose stored checksum differs is an error; one without is taken as it is."""
    root = qualified(files.sparkSession, root) if root else root  # not needed where uris has all shards
    schema = files.withColumn("content", F.lit(None).cast("binary")).schema
    return files.sortWithinPartitions("shard", "offset").mapInArrow(reader(files.columns, root, uris, check), schema)


def read_ranges(files: DataFrame, root: str, offset: int, size: int, uris: dict[int, str] | None = None) -> DataFrame:
    """files with the bytes [offset, offset + size) of each as content; only those are read, so no checksum is looked at. A file
    that ends earlier has fewer."""
    whole = F.coalesce("size", F.lit(0))
    from_ = F.least(F.lit(offset).cast("long"), whole)
    rows = files.withColumns({"_o": F.col("offset"), "_s": F.col("size"), "offset": F.col("offset") + from_, "size": F.least(whole - from_, F.lit(size).cast("long"))})
    out = read_contents(rows, root, uris, check=False)
    return out.withColumns({"offset": F.col("_o"), "size": F.col("_s")}).drop("_o", "_s")


def write_shards(placed: DataFrame, root: str, fetch: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, tasks: int | None = None) -> DataFrame:
    """Writes contents at their addresses and returns path, crc32c of each. placed: path, shard, offset, size, content. A task
    writes whole shards in order of address: a shard appears when it is complete, and a second run of a task replaces it.
    fetch, if given, adds content to batches of rows that are placed without it, in the tasks that write, so that no content is
    shuffled or passed between processes; tasks is then the number of tasks, which Spark can't tell from rows without contents."""
    root = qualified(placed.sparkSession, root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = file_system(root)
        attempt, out, current, at, part = TaskContext.get().taskAttemptId(), None, None, 0, ""

        def close() -> None:
            if out is not None:
                out.close()
                store.move(part, shard_uri(base, current))

        for batch in fetch(batches) if fetch else batches:
            contents = batch.column("content")
            raw, begins, ends = spans(contents)
            raw = memoryview(raw)
            for shard, offset, begin, end in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), begins.tolist(), ends.tolist()):
                if shard != current:
                    close()
                    current, at, part = shard, 0, f"{shard_uri(base, shard)}.{attempt}"
                    out = store.open_output_stream(part)
                while at < offset:  # a gap
                    n = min(offset - at, 1 << 20)
                    out.write(bytes(n))
                    at += n
                out.write(raw[begin:end])
                at += end - begin
            # paths as copies: a slice would hold all of the batch
            done = pa.RecordBatch.from_arrays([pa.array(batch.column("path").to_pylist(), pa.string()), pa.array(crc32c_spans(np.asarray(raw), begins, ends).astype(np.int64))], ["path", "crc32c"])
            batch = contents = raw = None
            yield done
        close()

    rows = (placed.repartition(tasks, "shard") if tasks else placed.repartition("shard")).sortWithinPartitions("shard", "offset")
    return (rows if fetch else rows.select("path", "shard", "offset", "content")).mapInArrow(write, "path string, crc32c long")
