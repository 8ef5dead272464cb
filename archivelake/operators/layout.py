"""Where files lie in shards: gaps, runs, placement, defragmentation.

Running totals over all files are taken in two steps, so no task sees all rows: rows are range-partitioned in their order, sums
of the parts are carried over (one row a part), and each part adds up its own rows. Placement stores its rows once and lays
chunks of them out side by side; the driver holds a row a part and a row a shard.
"""

from __future__ import annotations

import bisect
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NO_LIMIT, FileTooLarge
from ..sources import stores


def in_parts(rows: DataFrame, order: list[str], unique: str = "path") -> DataFrame:
    """rows with _part: range partitions in this order. An action: the table is stored, as every evaluation would draw other
    bounds and number other parts, and what belongs to a part is used in two places."""
    return stores.stored(rows.repartitionByRange(*order, unique).withColumn("_part", F.spark_partition_id()), "parts")


def running(parts: DataFrame, order: list[str], value: Column, name: str, unique: str = "path", best: bool = False) -> DataFrame:
    """parts (of in_parts) with the running sum of value, or its running maximum, in the whole order."""
    take = F.max if best else F.sum
    whole = parts.groupBy("_part").agg(take(value).alias("_held"))
    before = take("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.select("_part", before.alias("_before"))
    within = take(value).over(Window.partitionBy("_part").orderBy(*order, unique).rowsBetween(Window.unboundedPreceding, 0))
    out = parts.withColumn("_within", within).join(F.broadcast(whole), "_part")  # a row a partition
    join = F.greatest("_within", "_before") if best else F.coalesce("_within", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return out.withColumn(name, join).drop("_within", "_before")


#: Files that one task lays out by itself; bytes of a task's files, in shards, beyond that, at least.
ALONE, CHUNK = 1_000_000, 16
#: Shards up to which each end is looked up by itself where there are more files than that; files a shard from which it is too.
FEW, CROWD = 64, 250_000
#: Rows about which the driver gets from the chunks' tables.
JOINTS = 100_000


def laid_out(files: DataFrame, order: list[str], unique: str = "path") -> tuple[DataFrame, int, int]:
    """files as a stored table with _part, _number (from 1, in this order) and _end (bytes up to and with it), both counted
    within the part; with them _parts, how much stands before each part, as columns _n0 and _e0. Also the number of files and
    bytes. An action."""
    names = files.columns
    schema = files.withColumns({"_part": F.lit(0), "_number": F.lit(0).cast("long"), "_end": F.lit(0).cast("long")}).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, end = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = batch.column(names.index("size")).fill_null(0).cast(pa.int64()).to_numpy()
            ends = end + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(number + 1 + np.arange(len(batch))), pa.array(ends)], [*names, "_part", "_number", "_end"])
            if len(batch):
                number, end = number + len(batch), int(ends[-1])

    rows = stores.stored(files.repartitionByRange(*order, unique).sortWithinPartitions(*order, unique).mapInArrow(count, schema), "laid-out")
    held = rows.groupBy("_part").agg(F.max("_number").alias("n"), F.max("_end").alias("e")).orderBy("_part").collect()  # a row a part
    before, n, e = [], 0, 0
    for part, more, size in held:
        before.append((part, n, e))
        n, e = n + more, e + size
    parts = files.sparkSession.createDataFrame(before, "_part int, _n0 long, _e0 long")
    rows = rows.join(F.broadcast(parts), "_part").withColumns({"_number": F.col("_number") + F.col("_n0"), "_end": F.col("_end") + F.col("_e0")})
    return rows.drop("_part", "_n0", "_e0"), n, e


def _first_beyond(rows: DataFrame, last: int, base: int, limit: int) -> tuple[int, int] | None:
    """Number and start of the first file behind the last that ends more than limit behind base."""
    found = rows.filter((F.col("_end") > base + limit) & (F.col("_number") > last)).agg(F.min(F.struct("_number", (F.col("_end") - F.coalesce("size", F.lit(0))).alias("at")))).first()[0]
    return tuple(found) if found else None


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """chunk, numbers, ends and starts of each chunk of sorted rows (chunk, _number, _end, size), whole."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        of, *columns = (batch.column(i).to_numpy() for i in range(4))
        cuts = [0, *(np.nonzero(np.diff(of))[0] + 1).tolist(), len(of)] if len(of) else [0]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0][0] != of[a]:
                yield _joined(held)
                held = []
            held.append([of[a], *(c[a:b] for c in columns)])
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    number, end, size = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
    return int(held[0][0]), number, end, end - size


def _longs(names: list[str], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)


def shard_starts(rows: DataFrame, n: int, total: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the first file of each shard and the bytes before it, by next-fit, for rows of laid_out(). A file above
    limit has a shard of its own. An action; the result has a row a shard.

    Where a shard ends depends on where it began, so parts of the order can't be laid out by themselves. But the shard that is
    open where a chunk of the order begins can have begun at few places only, those less than limit before; and each of the
    chunk's first files has one last shard start that follows from it, found for all of them at once by pointer jumping. The
    driver follows the one true way through these tables, a lookup a chunk; then each chunk is laid out once, from where its
    first shard really began."""
    if total <= limit:
        return np.array([1]), np.array([0])
    if n > ALONE and (total <= FEW * limit or n > CROWD * (total // limit)):
        starts = [(1, 0)]
        while (found := _first_beyond(rows, starts[-1][0], starts[-1][1], limit)) is not None:
            starts.append(found)
        return tuple(np.array(x, np.int64) for x in zip(*starts))
    # chunks so large that their tables, a row for each file of a shard, stay small, but not beyond a task's memory
    width = min(max(CHUNK, n // JOINTS), max(CHUNK, CHUNK * CROWD * (total // limit) // n))
    chunk = F.lit(0) if n <= ALONE else F.expr(f"(_end - coalesce(size, 0)) div {width * limit}")
    thin = rows.select(chunk.cast("long").alias("chunk"), "_number", "_end", F.coalesce("size", F.lit(0)).alias("size"))

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, _, end, start in _by_chunk(batches):
            # the next shard's first file for a shard that begins at each file, and from there to the chunk's last
            at = np.arange(len(end))
            jump = np.maximum(np.searchsorted(end, start + limit, "right"), at + 1)
            jump = np.where(jump == len(end), at, jump)
            while not np.array_equal(further := jump[jump], jump):
                jump = further
            first = np.arange(min(len(end), int(np.searchsorted(end, start[0] + limit, "right")) + 1))
            out = start[jump[first]]
            last = np.append(np.nonzero(np.diff(out))[0], len(out) - 1)  # files that lead to the same start are one row
            yield _longs(["chunk", "upto", "base"], [np.full(len(last), now), end[last], out[last]])

    def lay(entries: dict[int, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for now, number, end, start in _by_chunk(batches):
                base, i, firsts = entries[now], -1, []
                while (i := i + 1 + int(np.searchsorted(end[i + 1 :], base + limit, "right"))) < len(end):
                    base = int(start[i])
                    firsts.append(i)
                yield _longs(["number", "base"], [number[firsts], start[firsts]])

        return run

    def dealt() -> DataFrame:
        return (thin.coalesce(1) if n <= ALONE else thin.repartition("chunk")).sortWithinPartitions("chunk", "_number")

    entries = {0: 0}
    if n > ALONE:
        thin = stores.stored(thin, "layout")
        table = dealt().mapInArrow(ways, "chunk long, upto long, base long").toArrow().sort_by([("chunk", "ascending"), ("upto", "ascending")])
        of, upto, out = (table.column(i).to_numpy() for i in range(3))
        cuts = [0, *(np.nonzero(np.diff(of))[0] + 1).tolist(), len(of)]
        base = 0
        for a, b in zip(cuts, cuts[1:]):
            entries[int(of[a])] = base
            i = a + int(np.searchsorted(upto[a:b], base + limit, "right"))
            base = int(out[i]) if i < b else base
    found = dealt().mapInArrow(lay(entries), "number long, base long").toArrow().sort_by("number")  # a row a shard
    number, base = (found.column(i).to_numpy() for i in range(2))
    own = number > 1  # the first file's shard is there already
    return np.append([1], number[own]), np.append([0], base[own])


def place(files: DataFrame, limit: int, order: list[str], unique: str = "path", alone: bool = False) -> DataFrame:
    """files with new_shard and new_offset by next-fit in this order: a file goes after the one before it unless it would end
    beyond limit; then it starts a new shard. A file above limit is an error, or, with alone, has a shard of its own. An action:
    files is read once and stored."""
    names = files.columns
    rows, n, total = laid_out(files, order, unique)
    if not alone and total > limit and (over := rows.filter(F.col("size") > limit).select(unique, "size").first()):
        raise FileTooLarge(f"{over[0]} has {over[1]} bytes; a shard holds {limit}")
    at = F.col("_end") - F.coalesce("size", F.lit(0))
    firsts, bases = shard_starts(rows, n, total, limit)
    if len(firsts) == 1:
        return rows.select(*names, F.lit(0).alias("new_shard"), at.alias("new_offset"))
    schema = rows.withColumns({"new_shard": F.lit(0), "new_offset": F.lit(0).cast("long")}).drop("_number", "_end").schema

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = np.searchsorted(firsts, batch.column("_number").to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(shard.astype(np.int32)), pa.array(batch.column("_at").to_numpy() - bases[shard])], schema.names)

    return rows.select(*names, "_number", at.alias("_at")).mapInArrow(put, schema)


def append(files: DataFrame, new: DataFrame, limit: int) -> DataFrame:
    """new files behind those of files: placed from the end of its last shard on, in path order. Columns of new."""
    last = files.agg(F.max(F.struct("shard", (F.col("offset") + F.col("size")).alias("end")))).first()[0]
    if last is None:
        return place(new, limit, ["path"]).withColumns({"shard": F.col("new_shard"), "offset": F.col("new_offset")}).drop("new_shard", "new_offset")
    filler = new.sparkSession.createDataFrame([("", int(last["end"]))], "path string, size long")
    rows = place(filler.unionByName(new, allowMissingColumns=True), limit, ["path"]).filter(F.col("path") != "")
    return rows.withColumns({"shard": (F.col("new_shard") + last["shard"]).cast("int"), "offset": F.col("new_offset")}).select(*new.columns)


def gaps(files: DataFrame, limit: int | None = None) -> DataFrame:
    """shard, offset, size of unused ranges before and between files; with a limit also behind the last one of each shard.
    Empty files bound no gap."""
    end = F.col("offset") + F.col("size")
    by = Window.partitionBy("shard").orderBy("offset", "size", "path")
    rows = files.filter("size > 0")
    # the end so far: also right where ranges overlap
    before = F.coalesce(F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.select("shard", before.alias("from"), "offset").filter(F.col("offset") > F.col("from")).select("shard", F.col("from").alias("offset"), (F.col("offset") - F.col("from")).alias("size"))
    if limit is not None:
        ends = files.groupBy("shard").agg(F.max(end).alias("offset")).withColumn("size", F.lit(limit) - F.col("offset"))
        out = out.unionByName(ends.filter("size > 0"))
    return out


def gap_stats(files: DataFrame) -> DataFrame:
    """Per shard with files: gap_bytes, gaps, largest, used_bytes, density (used bytes of the shard's extent; 1 if empty)."""
    found = gaps(files).groupBy("shard").agg(F.sum("size").alias("gap_bytes"), F.count("*").alias("gaps"), F.max("size").alias("largest"))
    used = files.groupBy("shard").agg(F.sum("size").alias("used_bytes"), F.max(F.col("offset") + F.col("size")).alias("extent"))
    out = used.join(found, "shard", "left").fillna(0, ["gap_bytes", "gaps", "largest"])
    return out.select("shard", "gap_bytes", "gaps", "largest", "used_bytes", F.when(F.col("extent") > 0, F.col("used_bytes") / F.col("extent")).otherwise(1.0).alias("density"))


def at_ranks(rows: DataFrame, value: str, picks: dict[str, tuple[int, int]]) -> DataFrame:
    """One row with the values at 0-based places floor(n * a / b) of the ascending order, by name: exact, over counts of equal
    values, whose running totals are taken in parts. An action."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    parts = in_parts(counts, [value], value)
    upto = running(parts, [value], F.col("_c"), "_upto", value)
    n = upto.agg(F.sum("_c").alias("_n"))
    both = upto.crossJoin(F.broadcast(n))  # one row
    return both.agg(*[F.min(F.when(F.col("_upto") > F.least(F.expr(f"_n * {a} div {b}"), F.col("_n") - 1), F.col(value))).alias(name) for name, (a, b) in picks.items()])


def outlier_threshold(files: DataFrame) -> DataFrame:
    return at_ranks(files, "size", {"threshold": (95, 100)})


def gap_distribution(files: DataFrame) -> DataFrame:
    found = gaps(files)
    ranks = at_ranks(found, "size", {"p25": (1, 4), "p50": (1, 2), "p75": (3, 4), "p90": (9, 10), "p99": (99, 100)})
    ends = found.agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"), F.avg("size").alias("mean"))
    return ends.crossJoin(ranks)  # one row each


def islands(files: DataFrame) -> DataFrame:
    """Runs of files without a gap between them: shard, offset, size, n_files."""
    by = Window.partitionBy("shard").orderBy("offset", "size", "path")
    end = F.col("offset") + F.col("size")
    new = F.when(F.col("offset") == F.lag(end).over(by), 0).otherwise(1)
    rows = files.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by))
    return rows.groupBy("shard", "_run").agg(F.min("offset").alias("offset"), F.sum("size").alias("size"), F.count("*").alias("n_files")).drop("_run")


def defrag_plan(files: DataFrame, limit: int = NO_LIMIT) -> DataFrame:
    """path, size and old and new address of each file when all move up in address order."""
    return place(files, limit, ["shard", "offset", "size"]).select("path", "size", "shard", "offset", F.col("new_shard").cast("int").alias("new_shard"), "new_offset")


def copies(plan: DataFrame) -> DataFrame:
    """Byte ranges to be copied for a plan: neighbours that stay neighbours are one range."""
    by = Window.partitionBy("shard", "new_shard").orderBy("offset", "size", "path")
    shift = F.col("offset") - F.col("new_offset")
    end = F.lag(F.col("offset") + F.col("size")).over(by)
    new = F.when((F.lag(shift).over(by) == shift) & (end == F.col("offset")), 0).otherwise(1)
    rows = plan.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by))
    out = rows.groupBy("shard", "new_shard", "_run").agg(F.min("offset").alias("offset"), F.min("new_offset").alias("new_offset"), F.sum("size").alias("size"), F.count("*").alias("n_files"))
    return out.drop("_run").filter((F.col("shard") != F.col("new_shard")) | (F.col("offset") != F.col("new_offset")))


def defrag_quick(files: DataFrame, limit: int | None = None, seconds: float | None = None, skip_normal: int = 2, skip_outlier: int = 10) -> list[tuple[str, int, int]]:
    """Moves from the end: each file goes to the first earlier gap that holds it, and its old place becomes a gap. Files that fit
    nowhere are passed over, few of ordinary size and some more of the largest 5 %; then all from the first of these on move up
    to the gaps right before them. (path, new shard, new offset), in the order in which bytes may be copied. Sequential by
    nature: it is for the tail of an archive, bounded by seconds (none: no bound) and by what may be passed over. An action.
    With a limit, the ends of shards are gaps as well. Empty files stay."""
    began = time.monotonic()
    holes = [list(r) for r in gaps(files, limit).orderBy("shard", "offset").toLocalIterator()]
    keys, room = [(s, o) for s, o, _ in holes], _FirstFit([n for *_, n in holes])
    threshold = outlier_threshold(files).first()[0] or 0
    tail = files.filter("size > 0").orderBy(F.desc("shard"), F.desc("offset"), F.desc("path")).select("path", "shard", "offset", "size")
    moves, freed, skipped, stuck = [], [], {True: 0, False: 0}, None
    for path, shard, offset, size in tail.toLocalIterator():
        if seconds is not None and time.monotonic() - began > seconds:
            break
        # what was freed lies behind all files that are still to come, so only the gaps that were there are looked at
        i = room.find(size)
        if i is None or i >= bisect.bisect_left(keys, (shard, offset)):
            stuck = (shard, offset)
            outlier = size >= threshold
            skipped[outlier] += 1
            if skipped[outlier] > (skip_outlier if outlier else skip_normal):
                break
            continue
        moves.append((path, holes[i][0], holes[i][1]))
        holes[i] = [holes[i][0], holes[i][1] + size, holes[i][2] - size]
        room.set(i, holes[i][2])
        freed.append((shard, offset, offset + size))
    if stuck is not None:
        gone = {path for path, _, _ in moves}
        ends, begins = {}, {}

        def free(shard: int, begin: int, end: int) -> None:
            if (shard, end) in ends:
                further = ends.pop((shard, end))
                del begins[shard, further]
                end = further
            if (shard, begin) in begins:
                earlier = begins.pop((shard, begin))
                del ends[shard, earlier]
                begin = earlier
            ends[shard, begin], begins[shard, end] = end, begin

        for s, o, n in holes:
            if n:
                free(s, o, o + n)
        for place in freed:
            free(*place)
        behind = (F.col("shard") > stuck[0]) | (F.col("shard") == stuck[0]) & (F.col("offset") >= stuck[1])
        for path, shard, offset, size in files.filter((F.col("size") > 0) & behind).orderBy("shard", "offset").select("path", "shard", "offset", "size").toLocalIterator():
            if path in gone or (shard, offset) not in begins:
                continue
            begin = begins.pop((shard, offset))
            del ends[shard, begin]
            moves.append((path, shard, begin))
            free(shard, begin + size, offset + size)
    return moves


class _FirstFit:
    """Sizes in a tree of maxima: the first that is large enough is found in as many steps as the tree is high."""

    def __init__(self, sizes: list[int]):
        self.width = 1 << max(len(sizes) - 1, 0).bit_length()
        self.most = [0] * self.width + sizes + [0] * (self.width - len(sizes))
        for k in range(self.width - 1, 0, -1):
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])

    def find(self, size: int) -> int | None:
        if self.most[1] < size:
            return None
        k = 1
        while k < self.width:
            k = 2 * k if self.most[2 * k] >= size else 2 * k + 1
        return k - self.width

    def set(self, i: int, size: int) -> None:
        k = i + self.width
        self.most[k] = size
        while k := k // 2:
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])


def find_space(files: DataFrame, size: int, limit: int) -> DataFrame:
    """The first gap, or shard's end, that holds size bytes."""
    return gaps(files, limit).filter(F.col("size") >= size).orderBy("shard", "offset").limit(1)


def find_space_for(files: DataFrame, path: str, size: int, limit: int) -> tuple[int, int]:
    """Where a file of files may go when it gets another size: where it is if what follows leaves room, else the first hole that
    holds it, else a new shard. An action."""
    shard, offset = files.filter(F.col("path") == path).select("shard", "offset").first()
    after = files.filter((F.col("shard") == shard) & (F.col("offset") > offset)).agg(F.min("offset")).first()[0]
    if size <= (limit if after is None else after) - offset:
        return shard, offset
    found = find_space(files, size, limit).select("shard", "offset").first()
    return tuple(found) if found else (files.agg(F.max("shard")).first()[0] + 1, 0)
