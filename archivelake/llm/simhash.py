"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints come from hashed word shingles. Equal fingerprints are one class; only distinct ones are compared, so copies
cost nothing further. Candidates share a key; those of a key are compared bit-sliced (``bitslice``). Tasks return stars of
their local components, not pairs.

Two ways to the keys:

- ``link_exact`` (small radius, 64 bits): two fingerprints that differ in at most 2 of four 16-bit pieces' bits agree on
  two whole pieces, so six keys of 32 bits find every pair. A key with more than ``HOT`` distinct fingerprints goes another
  exact way: two fingerprints within 2 bits share a neighbour within 1 bit of both, at most 65 fingerprints have the same
  neighbour, so each hot fingerprint is sent to its 65 neighbours and every neighbour's few are linked.
- ``link_near`` (large radius, wide fingerprints): seeded samples of bits are keys, one a table. A pair of documents with
  similarity s of their shingle sets is missed by all with probability (1 - (1 - a / pi) ** bits) ** tables, a the angle
  arccos(2s / (1 + s)). Bits grow with the logarithm of the number of fingerprints, so a key's members do not grow with the
  corpus, and tables with the bits, so that ``MISSED`` at 0.8 (less above) holds at every size. Few shingles scatter more, so
  sets of at most ``SHORT`` have further keys, the lowest hashes of the set, of which two sets of the least similarity always
  share one. The fingerprints of a key held by more than ``HELD`` are dealt to runs of half that, and every two runs are
  compared in a task of their own.

``link_near`` only proposes: what it joins is a group of candidates. ``link_similar`` compares the shingle sets in a group, all
with all, and only pairs of similarity ``SIMILAR`` or more become links. A class is a node named by its smallest doc_id first,
so the smallest node of a component carries the component's doc_id and nothing is looked up by component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bitslice import pooled
from .components import components
from .rolling import U, mix, stretches

#: Distinct fingerprints of a key from which it goes another way; members of small keys that are compared at once.
HOT, POOL, HELD = 8192, 32_768, 32_768
#: Pairs of the least similarity that no key finds, at most, by calculation; least bits of a key, and by how many they stay below
#: the logarithm of the number of fingerprints (a key has 64 members on average: comparing those costs less than more tables).
MISSED, KEY_BITS, BELOW = 0.0007, 12, 6
#: Of 256 bits: similarity 0.8 of shingle sets lets 39 differ, give or take 6; candidates may differ by four times that more.
NEAR_BITS, NEAR_RADIUS = 256, 64
#: Least share of common shingles among all of two sets, as a fraction. Shingles of a set that has keys of its own.
SIMILAR, SHORT = (4, 5), 40
#: Sets and shingles in a run of a large group's members; every two runs are compared in a task of their own.
RUN_SETS, RUN_SHINGLES = 512, 2_000_000

def shingles(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle. Words are cut at ASCII white space, A-Z in lower case; fewer words than shingle are
    one."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    cut = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in cut), np.uint64, n)


#: Words whose shingles are hashed at once.
WORDS = 1 << 17


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles of a text, cut as in shingles(), by their rolling hashes; sorted."""
    words, found = (text or "").encode("utf-8", "surrogatepass").lower().split(), []
    for first in range(0, max(1, len(words) - shingle + 1) if words else 0, WORDS):
        some = words[first : first + WORDS + shingle - 1]
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        n = max(1, len(some) - shingle + 1)
        begins = np.concatenate([[0], ends[:-1] + 1])[:n]
        found.append(stretches(np.frombuffer(b" ".join(some), np.uint8), begins, ends[min(shingle, len(some)) - 1 :]))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def folded(h: np.ndarray, words64: int) -> bytes:
    """The fingerprint of hashes: 8 * words64 bytes, highest bit first; the last 8 from the hashes themselves, the others from
    hashes remixed from them. Without hashes all bits are 0."""
    counts = np.zeros(64 * words64, np.int64)
    for at in range(0, len(h), 255 << 6):
        some = h[at : at + (255 << 6)]
        lanes = [some, *(mix(some + U((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)) for k in range(1, words64))]
        bits = np.unpackbits(np.stack(lanes, 1).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        # sums of 255 rows fit a byte
        rest = len(bits) % 255
        counts += bits[len(bits) - rest :].sum(0, np.uint8)
        counts += bits[: len(bits) - rest].reshape(-1, 255, 64 * words64).sum(1, np.uint8).sum(0, np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").tobytes()[::-1]


def fingerprint(text: str | None, shingle: int, words64: int) -> bytes:
    """The fingerprint of a text's shingles, each as often as it occurs."""
    return folded(shingles(text, shingle), words64)


def fingerprints(docs: DataFrame, shingle: int, words64: int = 1) -> DataFrame:
    """doc_id, h (a hash of the text, with doc_id the row's name) and fp, the fingerprint's bytes. A null text has no words;
    without words all bits are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("simhash")
        for batch in common.pieces(batches):
            found = [fingerprint(x.as_py(), shingle, words64) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.col("text")).mapInArrow(run, "doc_id long, h long, fp binary")


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, h (as in fingerprints), name (the fingerprint of the set of shingles and a hash of the set), n (its size), first
    (of a set of at most SHORT, the hashes of which a similar set has one too) and members (the set, 8 bytes a hash, sorted)."""
    from_all, of_all = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_digest

        common.held("simhash")
        for batch in common.pieces(batches):
            names, sizes, first, members = [], [], [], []
            for x in batch.column(2):
                each = shingle_set(x.as_py(), shingle)
                raw, n = each.astype("<u8").tobytes(), len(each)
                names.append(folded(each, NEAR_BITS // 64) + xxh64_digest(raw))
                sizes.append(n)
                first.append(raw[: 8 * (n - -(-n * from_all // of_all) + 1)] if 0 < n <= SHORT else b"")
                members.append(raw)
            arrays = [pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(first, pa.binary()), pa.array(members, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "h", "name", "n", "first", "members"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.col("text")).mapInArrow(run, "doc_id long, h long, name binary, n long, first binary, members binary")


def similar_components(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest index reachable from each of sets (of sorted hashes) over pairs of similarity SIMILAR or more."""
    m, (share, whole) = len(sets), SIMILAR
    sizes = np.array([len(x) for x in sets])
    if m == 2:
        common_ones = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, 0 if whole * common_ones >= share * (sizes.sum() - common_ones) else 1])
    label, at = np.arange(m), np.concatenate([[0], np.cumsum(sizes)])
    _, token, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(m), sizes)[np.argsort(token, kind="stable")]
    begins = np.concatenate([[0], np.cumsum(held)])[:-1]
    visited = np.zeros(m, bool)

    def visit(i: int) -> None:
        """Joins i with all that are similar to it."""
        visited[i] = True
        shared = np.zeros(m, np.int64)
        mine = token[at[i] : at[i + 1]]
        for part in np.array_split(mine, int(held[mine].sum()) // 4_000_000 + 1):
            times = held[part]
            spread = np.repeat(begins[part] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            shared += np.bincount(holder[spread], minlength=m)
        shared[i] = sizes[i]
        near = np.unique(label[whole * shared >= share * (sizes + sizes[i] - shared)])
        if len(near) > 1:
            label[np.isin(label, near)] = near[0]

    for i in range(m):
        if (label == label[i]).sum() == 1:
            visit(i)
    # each pair that is left open has a member outside the largest component
    largest = np.bincount(label).argmax()
    for i in np.nonzero(~visited & (label != largest))[0].tolist():
        visit(i)
    return label


def _compare(radius: int, words64: int):
    """Over rows (key, fp, low) sorted by key: the links of each key's fingerprints, as stars."""

    def links(keys: np.ndarray, fps: np.ndarray, low: pa.Array) -> Iterator[pa.RecordBatch]:
        label = pooled(keys, fps, radius)
        moved = np.nonzero((fps != fps[label]).any(axis=1))[0]  # a fingerprint may stand under a key twice
        if len(moved):
            as_bytes = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            to = label[moved]
            yield pa.RecordBatch.from_arrays([as_bytes(fps[moved]), low.take(pa.array(moved)), as_bytes(fps[to]), low.take(pa.array(to))], ["u", "u_low", "v", "v_low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("simhash")
        keys, fps, lows = np.empty(0, np.int64), np.empty((0, words64), np.uint64), pa.array([], pa.int64())
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, words64)])
            lows = pa.concat_arrays([lows, batch.column(2)])
            # whole keys; the last one may go on
            n = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if n >= POOL:
                yield from links(keys[:n], fps[:n], lows[:n])
                keys, fps, lows = keys[n:], fps[n:], lows[n:]
        if len(keys):
            yield from links(keys, fps, lows)

    return run


def node(low, fp):
    """The node of a class: nodes are in the order of their smallest doc_id, classes without one last."""
    return F.struct(low.isNull().alias("none"), low.alias("low"), fp.alias("fp"))


def _compared(keyed: DataFrame, radius: int, words64: int) -> DataFrame:
    found = keyed.select("key", "fp", "low").repartition("key").sortWithinPartitions("key").mapInArrow(_compare(radius, words64), "u binary, u_low long, v binary, v_low long")
    return found.select(node(F.col("u_low"), F.col("u")).alias("u"), node(F.col("v_low"), F.col("v")).alias("v"))


def link_exact(fps: DataFrame) -> DataFrame:
    """fps (fp: distinct 8-byte fingerprints, low: a smallest doc_id) -> (u, v): links between the nodes of all that are
    connected by steps of 2 bits or fewer."""
    piece = [F.substring(F.hex("fp"), 1 + 4 * i, 4) for i in range(4)]
    keys = [F.conv(F.concat(F.lit(str(k)), piece[i], piece[j]), 16, 10).cast("long") for k, (i, j) in enumerate(combinations(range(4), 2))]
    keyed = fps.select(F.explode(F.array(*keys)).alias("key"), "fp", "low")
    hot = common.stored(keyed.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "hot-keys")
    if hot.isEmpty():
        return _compared(keyed, 2, 1)
    links = _compared(keyed.join(common.joinable(hot), "key", "left_anti"), 2, 1)
    crowded = keyed.join(common.joinable(hot), "key", "left_semi").select("fp", "low").distinct()

    near = crowded.select("fp", node(F.col("low"), F.col("fp")).alias("node"), F.explode(F.array(F.lit(-1), *map(F.lit, range(64)))).alias("bit"))
    byte, mask = F.expr("bit div 8"), F.expr("shiftleft(1, cast(bit % 8 as int))")
    old = F.conv(F.substring(F.hex("fp"), (byte * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    new = F.lpad(F.hex(old.bitwiseXOR(mask)), 2, "0")
    turned = F.when(F.col("bit") < 0, F.hex("fp")).otherwise(F.overlay(F.hex("fp"), new, (byte * 2 + 1).cast("int"), F.lit(2)))
    star = near.select("node", turned.alias("h")).withColumn("near", F.unhex("h")).groupBy("near").agg(F.collect_set("node").alias("all")).filter(F.size("all") > 1)
    star = star.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).filter("u <> v").select("u", "v").distinct()
    return links.unionByName(star)


def keys_for(n: int) -> tuple[int, int]:
    """The bits of a key and the number of tables for n fingerprints."""
    bits = min(32, max(KEY_BITS, math.ceil(math.log2(max(n, 1))) - BELOW))
    share, whole = SIMILAR
    agree = (1 - math.acos(2 * share / (whole + share)) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log1p(-agree))


def link_near(fps: DataFrame, words64: int = NEAR_BITS // 64, radius: int = NEAR_RADIUS, tables: int | None = None, key_bits: int | None = None, seed: int = 7) -> DataFrame:
    """fps (fp: distinct fingerprints, first: further keys, 8 bytes each) -> (u, v): links among those within radius bits that
    share a key."""
    if key_bits is None or tables is None:
        key_bits, tables = keys_for(fps.count())
    random = np.random.default_rng(seed)
    chosen = [random.choice(64 * words64, key_bits, replace=False) for _ in range(tables)]

    def keys(with_fp: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.held("simhash")
            names = ["key", "fp"] if with_fp else ["key"]
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    some = batch.column(0).slice(at, 4096)
                    each = np.unpackbits(np.frombuffer(b"".join(some.to_pylist()), np.uint8).reshape(len(some), -1), axis=1, bitorder="little").astype(np.int64)
                    found = [(np.int64(k) << 32) | (each[:, bits] << np.arange(key_bits)).sum(1) for k, bits in enumerate(chosen)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.concat_arrays([some] * tables)][: len(names)], names)
                    more = [x.as_py() for x in batch.column(1).slice(at, 4096)]
                    owner = np.repeat(np.arange(len(more)), [len(x) // 8 for x in more])
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(more), "<i8")), some.take(pa.array(owner))][: len(names)], names)

        return run

    fps = fps.select("fp", "first")
    hot = fps.mapInArrow(keys(False), "key long").groupBy("key").count().filter(F.col("count") > HELD).select("key", F.ceil(F.col("count") * 2 / HELD).cast("int").alias("runs"))
    hot = common.stored(hot, "hot-keys")
    keyed = fps.mapInArrow(keys(True), "key long, fp binary")
    if not hot.isEmpty():
        own, others = F.pmod(F.xxhash64("fp"), F.col("runs")).cast("int"), F.expr("filter(sequence(0, coalesce(runs, 1) - 1), x -> runs is null or x <> own)")
        dealt = keyed.join(common.joinable(hot), "key", "left").withColumn("own", own).withColumn("other", F.explode(others))
        pair = F.when(F.col("runs").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
        keyed = dealt.select(pair.alias("key"), "fp")
    return _compared(keyed.withColumn("low", F.lit(None).cast("long")), radius, words64)


def link_similar(sets: DataFrame, classes: DataFrame, run_sets: int = RUN_SETS, run_shingles: int = RUN_SHINGLES) -> DataFrame:
    """sets (name, members), classes (name, low, n, group; a name once) -> (u, v): links between the nodes of similar sets of a
    group, as stars. A group of more than run_sets sets or run_shingles hashes is dealt to runs, and every two of them meet."""
    runs = F.ceil(F.greatest(F.count("*") / run_sets, F.sum("n") / run_shingles)).cast("int")
    groups = classes.groupBy("group").agg(F.count("*").alias("size"), runs.alias("runs")).filter("size > 1").select("group", "runs")
    groups = common.stored(groups, "near-groups")
    crowded = common.stored(classes.join(common.joinable(groups), "group").select("name", "low", "group", "runs"), "near-crowded")
    once = sets.join(common.joinable(crowded), "name").groupBy("name", "low", "group", "runs").agg(F.first("members").alias("members"))
    own = F.pmod(F.xxhash64("name"), F.col("runs")).cast("int")
    others = F.when(F.col("runs") <= 2, F.array(F.lit(-1))).otherwise(F.expr("filter(sequence(0, greatest(runs, 1) - 1), x -> x <> own)"))
    dealt = once.withColumn("own", own).withColumn("other", F.explode(others))
    pair = F.when(F.col("other") < 0, F.xxhash64("group")).otherwise(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")))

    def linked(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        label = similar_components([np.frombuffer(x[2], "<u8") for x in rows])
        moved = np.nonzero(label != np.arange(len(label)))[0].tolist()
        if moved:
            ends = [rows[i] for i in moved], [rows[label[i]] for i in moved]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in end], kind) for end in ends for k, kind in ((0, pa.binary()), (1, pa.int64()))], ["u", "u_low", "v", "v_low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("simhash")
        key, rows = None, []
        for batch in batches:
            for k, name, low, some in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                if k != key:
                    if len(rows) > 1:
                        yield from linked(rows)
                    key, rows = k, []
                rows.append((name.as_py(), low.as_py(), some.as_py()))
        if len(rows) > 1:
            yield from linked(rows)

    found = dealt.select(pair.alias("pair"), "name", "low", "members").repartition("pair").sortWithinPartitions("pair").mapInArrow(run, "u binary, u_low long, v binary, v_low long")
    return found.select(node(F.col("u_low"), F.col("u")).alias("u"), node(F.col("v_low"), F.col("v")).alias("v"))


def near_duplicates(docs: DataFrame, shingle: int = 5, exact: bool = False) -> DataFrame:
    """doc_id, h, fp, component (a fingerprint that names it) and component_id of each row of docs.

    exact: 64-bit fingerprints linked at 2 bits or fewer, all of them; otherwise sets of shingles linked at 0.8 similarity or
    more, each link checked against the sets (fp is then the set's fingerprint of 256 bits and a hash of it).
    component_id is the smallest doc_id (nulls aside; null if all are) that is reachable. Null and empty texts have no
    words, fingerprint zero, and are linked like any other. Rows with the same doc_id are kept as rows of their own. An empty
    table gives no rows. Columns of docs other than doc_id and text are left out, whatever their names.
    """
    with common.scope(docs.sparkSession):
        rows, of_class = map(common.keep, _classes(docs, shingle, exact))
    return rows.join(of_class, F.col("fp") == F.col("class")).select("doc_id", "h", "fp", "component_id", "component")


def _classes(docs: DataFrame, shingle: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: each row's doc_id, h and fp, and each fp's component."""
    rows = common.stored(fingerprints(docs, shingle) if exact else sketches(docs, shingle), "fingerprints")
    if exact:
        classes = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
        links = common.stored(link_exact(classes), "near-links")
    else:
        sets, rows = rows.select("name", "members"), common.stored(rows.select("doc_id", "h", F.col("name").alias("fp"), "n", "first"), "fingerprints")
        classes = common.stored(rows.groupBy("fp", "n", "first").agg(F.min("doc_id").alias("low")), "classes")
        print_of = F.substring("fp", 1, NEAR_BITS // 8)
        near = components(common.stored(link_near(classes.select(print_of.alias("fp"), "first").distinct()), "near-candidates"))
        near = near.select(F.col("node.fp").alias("_print"), F.col("component.fp").alias("group"))
        placed = classes.select(F.col("fp").alias("name"), "low", "n", print_of.alias("print")).join(near, F.col("print") == F.col("_print"), "left")
        placed = common.stored(placed.select("name", "low", "n", F.coalesce("group", "print").alias("group")), "near-placed")
        links = common.stored(link_similar(sets, placed), "near-links")
    member = components(links).select(F.col("node.fp").alias("_fp"), F.col("component.fp").alias("_component"), F.col("component.low").alias("_low"), F.lit(True).alias("_linked"))
    of_class = classes.join(member, F.col("fp") == F.col("_fp"), "left").select(F.col("fp").alias("class"), F.coalesce("_component", "fp").alias("component"), F.when(F.col("_linked"), F.col("_low")).otherwise(F.col("low")).alias("component_id"))
    of_class = common.stored(of_class, "class-components")
    return rows, of_class


def deduplicate(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of docs of each component: that of the lowest doc_id (nulls last), then of the lowest hash of its text. Of rows
    that repeat id and text, one."""
    with common.scope(docs.sparkSession):
        found = common.stored(near_duplicates(docs, shingle), "near-components")
        # a component's row is one with its doc_id; several only where an id (or null) is repeated
        own = F.col("doc_id").eqNullSafe(F.col("component_id"))
        first = found.filter(own).groupBy("component").agg(F.min("h").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select(F.col("component").alias("_of"), "_first")
        first = common.stored(first, "near-repeated")
        later = found.filter(own).join(common.joinable(first), F.col("component") == F.col("_of")).filter(F.col("h") != F.col("_first"))
        dropped = found.filter(~own).select("doc_id", "h").unionByName(later.select("doc_id", "h"))
        dropped = common.keep(common.stored(dropped.distinct(), "near-dropped"))
        repeated = not found.groupBy("doc_id", "h").count().filter("count > 1").isEmpty()
    dropped = dropped.select(F.col("doc_id").alias("__near_id"), F.col("h").alias("__near_is"))
    kept = docs.withColumn("__near_h", F.xxhash64("text")).join(common.joinable(dropped), F.col("doc_id").eqNullSafe(F.col("__near_id")) & (F.col("__near_h") == F.col("__near_is")), "left_anti")
    if repeated:
        kept = common.one_of_each(kept, ["doc_id", "__near_h"])
    return kept.select(*docs.columns)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: three-word shingles, links at 2 bits or fewer."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"), shingle=3, exact=True)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
