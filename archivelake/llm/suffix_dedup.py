"""Removal of repeated 100-byte strings by a sparse suffix array, sorted deep-shallow.

A byte goes if a string of ``WIDTH`` bytes covers it that also starts earlier (smaller doc_id, or earlier in the document).
Equal strings choose the same anchor in them: the 24-byte piece of least hash. So it is enough to look at anchors, about one
in 39 positions, each with the ``REACH`` bytes on its either side:

1. Anchors with hashes of piece and surroundings are shuffled by piece. Copies in one batch are settled there, so a hot
   passage costs a row a batch. An anchor alone with its piece is done; one whose surroundings stood earlier is repeated
   with all strings around it; only the first of each kind of surroundings, where a piece has several, is open.
2. The open anchors' surroundings are cut from the texts and shuffled by piece. A task sorts the suffixes that start at them
   deep-shallow, and the reversed texts before them as well. At each offset, strings are equal if they lie in the same
   intervals of common prefixes on both sides, so one pass an offset finds the first of every equal string. A piece with more
   than ``WARM`` kinds of surroundings is dealt by more than itself: its offsets are cut into ``RANGES`` ranges, and strings at
   offsets a to b agree in at least a bytes to the left and REACH - b to the right, so each range has groups of its own by these
   bytes. Groups of more than ``HOT`` go by the strings' own 128-bit hashes, pre-aggregated, with no group at all.
3. What repeats goes back to the documents and merges into spans.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .rolling import BYTE, U, mix, powers
from .suffix_sort import deep_shallow

WIDTH, PIECE = 100, 24
REACH = WIDTH - PIECE
SPAN = REACH + 1
#: Windows of a piece of text that is hashed at once; bytes of texts in a batch; open anchors sorted at once, kinds of a hot piece.
SEGMENT, BATCH, CHUNK, HOT = 1 << 21, 1 << 22, 40_000, 40_000
#: Kinds of surroundings from which a piece's groups are cut by ranges of offsets, and their number.
WARM, RANGES = 500, 4

def sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """best of each run of width values, from running bests of blocks in both directions."""
    n = len(x)
    rows = np.zeros((-(-n // width), width), x.dtype)
    rows.ravel()[:n] = x
    before = best.accumulate(rows, axis=1).ravel()
    behind = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], before[width - 1 : n])


def anchors(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Of texts laid end to end in raw: their bounds in it, and the range of window starts of each -> anchor positions, hash of
    the piece, hash of the surroundings."""
    n = len(raw)
    none = np.empty(0, np.int64)
    if n < WIDTH:
        return none, none, none
    up, down = powers(n + 1)
    total = np.concatenate([[U(0)], np.cumsum(BYTE[raw] * up[:n], dtype=U)])
    piece = mix((total[PIECE:] - total[:-PIECE]) * down[: n - PIECE + 1])
    piece[piece == 0] = 1
    least = sliding(np.minimum, piece, SPAN)  # of the pieces in the window that starts here
    edge = np.zeros(len(least) + 1, np.int64)
    np.add.at(edge, np.minimum(first, len(least)), 1)
    np.add.at(edge, np.minimum(np.maximum(first, last), len(least)), -1)
    least[np.cumsum(edge[:-1]) == 0] = 0
    pad = np.zeros(REACH, U)
    at = np.nonzero(sliding(np.maximum, np.concatenate([pad, least, pad]), SPAN)[: len(piece)] == piece)[0]
    of = np.searchsorted(begin, at, "right") - 1
    left, right = np.maximum(at - REACH, begin[of]), np.minimum(at + WIDTH, end[of])
    around = mix((total[right] - total[left]) * down[left] + mix((((at - left) << 8) | (right - at)).astype(U)))
    return at, piece[at].view(np.int64), around.view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows part (what to shuffle by), piece, around, key, at, kind: 0 to be compared, 1 repeated for sure."""
    parts: list[tuple] = []
    held = 0

    def settle() -> Iterator[pa.RecordBatch]:
        raw = np.concatenate([x[1] for x in parts])
        ends = np.cumsum([len(x[1]) for x in parts])
        begins = ends - np.array([len(x[1]) for x in parts])
        # a segment's bounds are the document's own only where the document ends; its margins cover all surroundings
        at, piece, around = anchors(raw, begins, ends, begins + np.array([x[3] for x in parts]), begins + np.array([x[4] for x in parts]))
        of = np.searchsorted(begins, at, "right") - 1
        key = np.array([x[0] for x in parts], np.int64)[of]
        place = at - begins[of] + np.array([x[2] for x in parts], np.int64)[of]
        order = np.lexsort((place, key, around, piece))
        piece, around, key, place = piece[order], around[order], key[order], place[order]
        same = np.concatenate([[False], (piece[1:] == piece[:-1]) & (around[1:] == around[:-1])])
        twice = np.concatenate([[False], same[1:] & (key[1:] == key[:-1]) & (place[1:] == place[:-1])])
        piece, around, key, place, same = (x[~twice] for x in (piece, around, key, place, same))
        part = np.where(same, key, piece)
        for a in range(0, len(key), 20_000):
            s = slice(a, a + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (part, piece, around, key, place.astype(np.int32), same.astype(np.int32))], ["part", "piece", "around", "key", "at", "kind"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
            windows = len(raw) - WIDTH + 1
            for s in range(0, max(windows, 0), SEGMENT):
                e = min(s + SEGMENT, windows)
                low = max(0, s - REACH)
                segment = raw[low : min(len(raw), e + WIDTH + REACH)]
                parts.append((key, segment, low, s - low, e - low))
                held += len(segment)
                if held >= BATCH:
                    yield from settle()
                    parts, held = [], 0
    if parts:
        yield from settle()


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (piece, around, key, at, kind) in this order, those of kind 1 first: key, at, piece and kind of what is
    repeated (1) or open (0). State is one row: the piece's first, held back until another kind of surroundings shows up."""
    held = None  # piece, around, key, at of the last row; then the piece's first row if it is still alone
    alone = None
    for batch in batches:
        if not len(batch):
            continue
        piece, around, key, at, kind = (batch.column(i).to_numpy() for i in range(5))
        sure = kind == 1
        out = [(key[sure], at[sure], piece[sure], kind[sure])]
        piece, around, key, at = (x[~sure] for x in (piece, around, key, at))
        if len(piece):
            last = held or (piece[0] ^ 1, 0, 0, -1)
            p, c, k, a = (np.concatenate([[x], y]) for x, y in zip(last, (piece, around, key, at)))
            new = p[1:] != p[:-1]
            kin = ~new & (c[1:] == c[:-1])
            twice = kin & (k[1:] == k[:-1]) & (a[1:] == a[:-1])
            other = ~new & ~kin  # opens a further kind of surroundings
            run = np.cumsum(new)
            first = np.concatenate([[-1], np.nonzero(new)[0]])
            if alone is not None and (other & (run == 0)).any():
                out.append(tuple(np.array([x]) for x in (alone[2], alone[3], alone[0], 0)))
                alone = None
            several = np.unique(run[other])
            starts = first[several[several > 0]]
            again = kin & ~twice
            out.append((key[again], at[again], piece[again], np.ones(again.sum(), np.int32)))
            out.append((key[other], at[other], piece[other], np.zeros(other.sum(), np.int32)))
            out.append((key[starts], at[starts], piece[starts], np.zeros(len(starts), np.int32)))
            if new.any():
                i = np.nonzero(new)[0][-1]
                alone = None if other[i + 1 :].any() else (piece[i], around[i], key[i], at[i])
            held = (piece[-1], around[-1], key[-1], at[-1])
        key, at, piece, kind = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(piece.astype(np.int64)), pa.array(kind.astype(np.int32))], ["key", "at", "piece", "kind"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (key, packed text, open: pieces, places, warm): group, key, at, left (reversed) and right surroundings, and the range
    of offsets that the group is for."""
    from xxhash import xxh64_intdigest

    bounds = [REACH * i // RANGES for i in range(RANGES + 1)]
    ranges = [(a + (i > 0), b) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    for batch in batches:
        for i in range(0, len(batch), 64):
            rows = []
            for key, packed, open_ in zip(*(batch.column(c).slice(i, 64).to_pylist() for c in range(3))):
                raw = zlib.decompress(packed)
                for x in open_:
                    at, left, right = x["at"], raw[max(0, x["at"] - REACH) : x["at"]][::-1], raw[x["at"] : x["at"] + WIDTH]
                    if not x["warm"]:
                        rows.append((x["piece"], key, at, left, right, 0, REACH))
                        continue
                    for a, b in ranges:
                        if len(left) >= a and len(right) >= WIDTH - b:
                            group = xxh64_intdigest(b"%d %d " % (x["piece"], a) + left[:a] + right[: WIDTH - b])
                            rows.append((group - (1 << 63), key, at, left, right, a, b))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["piece", "key", "at", "left", "right", "first", "last"])


def repeated_offsets(key: np.ndarray, at: np.ndarray, left: list[bytes], right: list[bytes], begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For anchors with reversed left and right surroundings: the least and greatest offset, from begin to end, of an anchor in
    a string that starts earlier (key, at) in such surroundings as well; (1, 0) where there is none."""
    rank = np.lexsort((at, key))
    left, right, begin, end = [left[i] for i in rank], [right[i] for i in rank], begin[rank], end[rank]
    n = len(rank)
    sides = []
    for strings, shallow in ((left, 16), (right, PIECE)):
        order, lcps = deep_shallow(strings, shallow)
        sides.append((np.array(order), np.array(lcps), np.fromiter(map(len, strings), np.int64, n)))
    (lorder, llcp, llen), (rorder, rlcp, rlen) = sides
    low, high = np.full(n, 1, np.int64), np.zeros(n, np.int64)
    lid, rid = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(REACH + 1):
        fits = np.nonzero((llen >= o) & (rlen >= WIDTH - o) & (begin <= o) & (o <= end))[0]
        if len(fits) < 2:
            continue
        lid[lorder], rid[rorder] = np.cumsum(llcp < o), np.cumsum(rlcp < WIDTH - o)
        same = lid[fits] * (n + 1) + rid[fits]
        _, first = np.unique(same, return_index=True)
        later = np.ones(len(fits), bool)
        later[first] = False
        hit = fits[later]
        low[hit] = np.where(low[hit] > high[hit], o, low[hit])
        high[hit] = o
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    a[rank], b[rank] = low, high
    return a, b


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (piece, key, at, left, right, first, last) sorted by piece: key, at, low, high of what is repeated, for whole pieces at a time."""
    piece, key, at, begin, end = (np.empty(0, np.int64) for _ in range(5))
    left, right = [], []

    def solve(n: int) -> pa.RecordBatch:
        a, b = repeated_offsets(key[:n], at[:n], left[:n], right[:n], begin[:n], end[:n])
        hit = a <= b
        return pa.RecordBatch.from_arrays([pa.array(key[:n][hit]), pa.array(at[:n][hit].astype(np.int32)), pa.array(a[hit].astype(np.int32)), pa.array(b[hit].astype(np.int32))], ["key", "at", "low", "high"])

    for batch in batches:
        piece, key, at, begin, end = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in zip((0, 1, 2, 5, 6), (piece, key, at, begin, end)))
        left += batch.column(3).to_pylist()
        right += batch.column(4).to_pylist()
        while len(piece) >= CHUNK:
            ends = np.nonzero(np.diff(piece))[0] + 1
            if not len(ends):
                break
            n = int(ends[max(0, np.searchsorted(ends, CHUNK, "right") - 1)])
            yield solve(n)
            piece, key, at, begin, end, left, right = (x[n:] for x in (piece, key, at, begin, end, left, right))
    if len(piece):
        yield solve(len(piece))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string around an anchor by itself: offset and 128-bit hash."""
    from xxhash import xxh3_128_digest

    for batch in batches:
        for i in range(0, len(batch), 256):
            rows = []
            for _, key, at, left, right, first, last in zip(*(batch.column(c).slice(i, 256).to_pylist() for c in range(7))):
                whole, lead = left[::-1] + right, len(left)
                rows.extend((key, at, o, xxh3_128_digest(whole[lead - o : lead - o + WIDTH])) for o in range(max(first, WIDTH - len(right)), min(last, lead) + 1))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], ["key", "at", "offset", "string"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 512):
            texts = [zlib.compress((x or "").encode("utf-8", "surrogatepass"), 1) for x in batch.column(2).slice(i, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 512), batch.column(1).slice(i, 512), pa.array(texts, pa.binary())], ["key", "doc_id", "packed"])


def _removed(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                rows = []
                for doc, packed, found in zip(*(batch.column(c).slice(i, 256).to_pylist() for c in range(3))):
                    raw, spans = zlib.decompress(packed), []
                    if found:
                        at = np.array([x["at"] for x in found], np.int64)
                        low = np.maximum(np.array([x["low"] for x in found]), np.maximum(0, at + WIDTH - len(raw)))
                        high = np.minimum(np.array([x["high"] for x in found]), at)
                        fits = low <= high
                        edge = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(edge, (at - high)[fits], 1)
                        np.add.at(edge, (at - low + WIDTH)[fits], -1)
                        turns = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]])))
                        spans = turns.reshape(-1, 2).tolist()
                    rest, last = [], 0
                    for a, b in spans:
                        rest.append(raw[last:a])
                        last = b
                    kept = b"".join([*rest, raw[last:]]) if spans else raw
                    rows.append((doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"begin": a, "end": b} for a, b in spans], kept if keep else None))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with key, a long whose order is the documents': doc_id itself if all are different and not null. Else rows get
    numbers in the order of doc_id (null first) and text hash; rows that repeat both follow each other."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    if docs.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull()).isEmpty():
        return docs.select(F.col("doc_id").alias("key"), "doc_id", "text")
    order = [F.col("doc_id"), F.xxhash64("text")]
    laid = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = common.stored(laid.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    return laid.select(F.col("_id").alias("key"), "doc_id", "text")


def remove_repeats(docs: DataFrame, keep: bool = True, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges [begin, end)), kept (the bytes that
    remain; null unless keep).

    A null text is empty. A row with the id of another comes later if its text's hash is greater; rows that repeat id and text
    count as one after the other. A null id comes before all others. Other columns of docs are left out.
    """
    docs = _keyed(docs)
    rows = docs.select("key", "text").mapInArrow(_anchor_rows, "part long, piece long, around long, key long, at int, kind int")
    order = [F.desc("kind"), "piece", "around", "key", "at"]
    found = rows.repartition("part").select("piece", "around", "key", "at", "kind").sortWithinPartitions(*order).mapInArrow(_classify, "key long, at int, piece long, kind int")
    found = common.stored(found, "anchors")

    packed = docs.mapInArrow(_packed, "key long, doc_id long, packed binary")
    open_ = found.filter("kind = 0").select("key", "piece", "at")
    warm = common.stored(open_.groupBy("piece").count().filter(F.col("count") > min(WARM, hot)), "warm-pieces")
    marked = open_.join(common.joinable(warm.select("piece", F.lit(True).alias("warm"))), "piece", "left")
    open_ = marked.groupBy("key").agg(F.collect_list(F.struct("piece", "at", F.coalesce("warm", F.lit(False)).alias("warm"))).alias("open"))
    columns = ["piece", "key", "at", "left", "right", "first", "last"]
    cut = packed.select("key", "packed").join(open_, "key").mapInArrow(_cut, "piece long, key long, at int, left binary, right binary, first int, last int")
    if warm.filter(F.col("count") > hot).isEmpty():
        partly = cut.repartition("piece").sortWithinPartitions("piece").mapInArrow(_sorted, "key long, at int, low int, high int")
    else:
        cut = common.stored(cut, "surroundings")
        crowded = common.stored(cut.groupBy("piece").count().filter(F.col("count") > hot).select("piece"), "hot-pieces")
        cold = cut.join(common.joinable(crowded), "piece", "left_anti").select(*columns)
        partly = cold.repartition("piece").sortWithinPartitions("piece").mapInArrow(_sorted, "key long, at int, low int, high int")
        strings = cut.join(common.joinable(crowded), "piece", "left_semi").select(*columns).mapInArrow(_hashed, "key long, at int, offset int, string binary")
        first = strings.groupBy("offset", "string").agg(F.min(F.struct("key", "at")).alias("first"))
        later = strings.join(first, ["offset", "string"]).filter(F.struct("key", "at") > F.col("first"))
        partly = partly.unionByName(later.groupBy("key", "at").agg(F.min("offset").alias("low"), F.max("offset").alias("high")))
    whole = found.filter("kind = 1").select("key", "at", F.lit(0).alias("low"), F.lit(REACH).alias("high"))
    spans = whole.unionByName(partly).groupBy("key").agg(F.collect_list(F.struct("at", "low", "high")).alias("found"))
    return packed.join(spans, "key", "left").select("doc_id", "packed", "found").mapInArrow(_removed(keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of documents; nulls, long texts, repeated rows, empty tables
    and further columns as in ``remove_repeats``."""
    found = remove_repeats(common.table(spark, sf_dir, "documents"), keep=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
