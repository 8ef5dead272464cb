"""Benchmark decontamination with an FM-index per shard of the training text.

A shard is a batch of whole documents in one task. Its words become numbers of the benchmark's vocabulary. An occurrence of
a test phrase can only lie in a stretch whose every pair of neighbours stands in some phrase, so the index holds exactly
those stretches of the shard that are as long as a phrase (and words that are phrases by themselves); nothing that could
match is left out. All phrases are searched backwards through wavelet-tree ranks at once, occurrences are located by
sampled suffix positions, and the words they cover merge into removal spans.

No shuffle is needed: documents stay where they are read and the compiled phrases, of a checked size, go to them. A benchmark
larger than ``SLICE_BYTES`` is cut by item into slices of about that size, and documents pass through one scan a slice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .fm_index import FMIndex

WINDOW = 10
SLICE_BYTES = 8 << 20
#: Words of a shard, at most about.
SHARD_WORDS = 1_000_000

_CLASS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def plain(text: str | None) -> bytes:
    """The text's UTF-8 bytes with A-Z in lower case and a space for whatever is in no word; offsets stay."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLASS)


class Phrases:
    """The distinct windows of benchmark items (id, text): numbers of words from 1, windows by length, items by window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        found: dict[tuple, set[str]] = {}
        for key, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in plain(text).split()]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add("" if key is None else str(key))
        self.lengths = sorted({len(w) for w in found})
        self.windows = {n: np.array([w for w in found if len(w) == n], np.int64) for n in self.lengths}
        self.items = {n: [found[w] for w in found if len(w) == n] for n in self.lengths}
        self.base = len(self.number) + 1
        pairs = [w[:, i] * self.base + w[:, i + 1] for n, w in self.windows.items() for i in range(n - 1)]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.single = np.zeros(self.base, bool)
        if 1 in self.windows:
            self.single[self.windows[1][:, 0]] = True
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashed(self.pairs)] = True

    @staticmethod
    def hashed(pairs: np.ndarray) -> np.ndarray:
        return (pairs * 0x9E3779B1 >> 12) & 0xFFFFF

    def stretches(self, words: np.ndarray) -> np.ndarray:
        """Positions of words (0: none of the benchmark's) that an occurrence may cover."""
        keep = self.single[words]
        longer = [n for n in self.lengths if n > 1]
        if longer and len(words) > 1:
            pair = words[:-1].astype(np.int64) * self.base + words[1:]
            at = np.nonzero(self.maybe[self.hashed(pair)] & (words[:-1] > 0) & (words[1:] > 0))[0]
            at = at[np.isin(pair[at], self.pairs)]
            if len(at):
                cut = np.nonzero(np.diff(at) != 1)[0]
                first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1
                whole = last - first + 1 >= longer[0]
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, first[whole], 1)
                np.add.at(edge, last[whole] + 1, -1)
                keep = keep | (np.cumsum(edge[:-1]) > 0)
        return np.nonzero(keep)[0]

    def occurrences(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By length: the window's number and the position of each occurrence in words."""
        at = self.stretches(words)
        if not len(at):
            return
        gaps = np.nonzero(np.diff(at) != 1)[0] + 1
        index = FMIndex(np.insert(words[at], gaps, 0))  # 0 parts stretches: no phrase has it
        place = np.insert(at, gaps, -1)
        for n in self.lengths:
            low, high = index.search(self.windows[n])
            count = high - low
            if count.any():
                which = np.repeat(np.arange(len(count)), count)
                rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                yield n, which, place[index.locate(rows)]


def _shards(batches: Iterator[pa.RecordBatch], phrases: Phrases):
    """(batch, words of each document as numbers) for runs of documents with a bounded number of words."""
    number = phrases.number.get
    for batch in batches:
        begin, held, texts = 0, [], batch.column("text")
        total = 0
        for i in range(len(batch)):
            words = plain(texts[i].as_py()).split()
            held.append(np.fromiter((number(w, 0) for w in words), np.int32, len(words)))
            total += len(words)
            if total >= SHARD_WORDS or i + 1 == len(batch):
                yield batch.slice(begin, i + 1 - begin), held
                begin, held, total = i + 1, [], 0


def _hits(docs: list[np.ndarray], phrases: Phrases) -> tuple[list[np.ndarray], list[set]]:
    """For each document: the merged word ranges that occurrences cover (pairs), and the items."""
    sizes = np.array([len(x) + 1 for x in docs])
    start = np.concatenate([[0], np.cumsum(sizes)])
    words = np.concatenate([y for x in docs for y in (x, np.zeros(1, np.int32))])
    cover, items = np.zeros(len(words) + 1, np.int32), [set() for _ in docs]
    for n, which, at in phrases.occurrences(words):
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        for d, w in np.unique(np.stack([np.searchsorted(start, at, "right") - 1, which], 1), axis=0).tolist():
            items[d] |= phrases.items[n][w]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]])))
    ranges = edge.reshape(-1, 2)
    of = np.searchsorted(start, ranges[:, 0], "right") - 1
    return [ranges[of == d] - start[d] if items[d] else ranges[:0] for d in range(len(docs))], items


def _merged(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES, keep: tuple[str, ...] = (), cut: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans, kept_text (the last two are
    null unless cut).

    spans are byte ranges [begin, end) of the UTF-8 text, from the first to the last word of each run of hit words;
    kept_text is the text without them (null where there are none: the text itself). A null text has no words. An item
    without words has no window; a null item id counts as the id ''; items that share an id count once. With an empty
    benchmark nothing is hit. Repeated rows each count; other columns of either table are left out, but for those of docs in
    keep, which come last, under their names with an underscore before them.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("key"), F.col("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-total // slice_bytes))
    out = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.lit(None).cast("array<int>").alias("hits"), F.lit(None).cast("array<string>").alias("items"), *[F.col(c).alias(f"_{c}") for c in keep])
    kept_names = [f"_{c}" for c in keep]
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in out.schema.fields[4:])
    for k in range(slices):
        part = items.filter(F.pmod(F.xxhash64("key", "text"), F.lit(slices)) == k) if slices > 1 else items
        held = spark.sparkContext.broadcast(Phrases([tuple(r) for r in part.collect()], window))
        final = k + 1 == slices
        schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<begin:long,end:long>>, kept_text string" if final else "doc_id long, text string, hits array<int>, items array<string>"
        schema += more

        def scan(batches: Iterator[pa.RecordBatch], held=held, final=final) -> Iterator[pa.RecordBatch]:
            common.held("decontamination")
            phrases = held.value
            for batch, words in _shards(batches, phrases):
                ranges, found = _hits(words, phrases)
                before, earlier = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
                ranges = [_merged(r.tolist() + [list(x) for x in zip(b[::2], b[1::2])]) if b else r.tolist() for r, b in zip(ranges, before)]
                found = [sorted(f | set(e or ())) for f, e in zip(found, earlier)]
                if not final:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array([[x for r in rs for x in r] for rs in ranges], pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())), *map(batch.column, kept_names)], ["doc_id", "text", "hits", "items", *kept_names])
                    continue
                spans, kept = [], []
                for i, rs in enumerate(ranges):
                    if not rs or not cut:
                        spans.append([] if cut else None)
                        kept.append(None)
                        continue
                    text = batch.column("text")[i].as_py()
                    at = [m.span() for m in _WORD.finditer(plain(text))]
                    spans.append([{"begin": at[a][0], "end": at[b - 1][1]} for a, b in rs])
                    raw, last, rest = text.encode("utf-8", "surrogatepass"), 0, []
                    for s in spans[-1]:
                        rest.append(raw[last : s["begin"]])
                        last = s["end"]
                    kept.append(b"".join([*rest, raw[last:]]).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(x) for x in words], pa.int64()),
                        pa.array([sum(b - a for a, b in r) for r in ranges], pa.int64()),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]),
                        pa.array([bool(r) for r in ranges]),
                        pa.array(found, pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                        pa.array(kept, pa.string()),
                        *map(batch.column, kept_names),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", "kept_text", *kept_names],
                )

        out = out.mapInArrow(scan, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated."""
    found = decontaminate(docs, benchmark, keep=tuple(docs.columns), cut=False).filter(~F.col("contaminated"))
    return found.select(*[F.col(f"_{c}").alias(c) for c in docs.columns])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of documents; nulls, empty texts, repeated rows and
    ids, empty tables and further columns as in ``decontaminate``."""
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), cut=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
