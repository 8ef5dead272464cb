"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each dimension: 1 where the value is 0 or more. Codes are cut into ``SEGMENTS`` segments. After
all values within segment radius s of a query's have been looked up, every code within m * (s + 1) - 1 bits has been seen, m
the number of segments: were all m segments more than s bits off, the code would be m * (s + 1) bits off at least. So radii
grow until the kth verified distance of each query is within that bound; queries leave as theirs is.

Rows with equal codes are one entry with its k lowest ids (ties go to the lower id, so the rest can't be returned), and equal
query codes are searched once; a code that a third of all rows share costs no more than another. Buckets and the queries that
look into them are packed in chunks of bounded size and meet on the segment's value; a pair of chunks is verified by XOR and
popcount and returns only what is within the query's kth distance so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS, SEGMENTS, K, EVERY = 64, 4, 10, 50
WIDTH = BITS // SEGMENTS
CHUNK = 4096


def codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and code (a long) of rows; vectors that are null have no code and are left out. Missing dimensions give bit 0,
    further ones than BITS are not part of a code."""
    bit = lambda i: F.when(F.coalesce(F.get(vector_col, F.lit(i)) >= 0, F.lit(False)), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(0)
    code = bit(0).cast("long")
    for i in range(1, BITS):
        code = code.bitwiseOR(bit(i).cast("long"))
    return rows.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), code.alias("code"))


def _lowest(rows: DataFrame, k: int) -> DataFrame:
    """code, ids: the k lowest ids of each (null ids last). Ranks are limited before the shuffle."""
    order = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    kept = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    return kept.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias("ids"))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code = batch.column(0).to_numpy().view(np.uint64)
        keys = [(code >> np.uint64(WIDTH * m) & np.uint64((1 << WIDTH) - 1)).astype(np.int64) | (m << WIDTH) for m in range(SEGMENTS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(code.view(np.int64), SEGMENTS))], ["key", "code"])


def _probes(radius: int):
    turns = np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), radius)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 16):
                code, bound = batch.column(0).slice(at, 16).to_numpy(), batch.column(1).slice(at, 16).to_numpy()
                for m in range(SEGMENTS):
                    value = (code.view(np.uint64) >> np.uint64(WIDTH * m) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
                    key = ((value[:, None] ^ turns[None, :]) | (m << WIDTH)).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(code, len(turns))), pa.array(np.repeat(bound, len(turns)))], ["key", "query", "bound"])

    return run


def _verify(k: int):
    """Over pairs of chunks (queries with bounds, codes): query, code, distance of the k nearest of the chunk, with ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for asked, codes_ in zip(batch.column(0), batch.column(1)):
                asked, code = asked.as_py(), np.array(codes_.as_py(), np.int64)
                query, bound = np.array([x["query"] for x in asked], np.int64), np.array([x["bound"] for x in asked], np.int64)
                for at in range(0, len(query), 256):
                    q = query[at : at + 256]
                    d = np.bitwise_count((q[:, None] ^ code[None, :]).view(np.uint64)).astype(np.int64)
                    most = bound[at : at + 256]
                    if len(code) > k:
                        most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
                    i, j = np.nonzero(d <= most[:, None])
                    out.append((q[i], code[j], d[i, j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query", "code", "distance"])

    return run


def _dealt(keyed: DataFrame, value: str, n: int) -> DataFrame:
    """keyed (key and value) with part: a key has as many parts as chunks fill, most keys one. n: most rows that a key can have."""
    if n <= CHUNK:
        return keyed.withColumn("part", F.lit(0))
    hot = keyed.groupBy("key").count().filter(F.col("count") > CHUNK).select("key", F.ceil(F.col("count") / CHUNK).alias("parts"))
    hot = common.joinable(common.stored(hot, "hot-keys"))
    return keyed.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64(value), F.coalesce("parts", F.lit(1)))).drop("parts")


def top_k(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """index and queries (id, code) -> query_id, rank (from 1), vec_id, distance: each query's k nearest rows of the index by
    Hamming distance, ties by the lower id (null ids last); all of them where the index has fewer. An empty index or no queries
    give no rows. Repeated rows of the index each have a rank; a query row that is repeated is answered as often. Other columns
    of both are left out."""
    entries = common.stored(_lowest(index, k), "code-entries")
    keyed = entries.select("code").mapInArrow(_buckets, "key long, code long")
    buckets = _dealt(keyed, "code", entries.count()).groupBy("key", "part").agg(F.collect_list("code").alias("codes"))
    buckets = common.stored(buckets.select("key", "codes"), "code-buckets")
    open_ = common.stored(queries.select(F.col("code").alias("query")).distinct().withColumn("bound", F.lit(BITS).cast("long")), "open-queries")
    best = None
    done = None
    for radius in range(WIDTH + 1):
        n = open_.count()
        if not n:
            break
        asked = open_.mapInArrow(_probes(radius), "key long, query long, bound long")
        asked = _dealt(asked, "query", n).groupBy("key", "part").agg(F.collect_list(F.struct("query", "bound")).alias("asked"))
        # packed rows are far larger in memory than on disk: never a broadcast by estimated size
        seen = asked.join(buckets.hint("merge"), "key").select("asked", "codes").mapInArrow(_verify(k), "query long, code long, distance long")
        seen = seen.distinct().join(entries.select("code", F.size("ids").alias("n")).hint("merge"), "code")
        if best is not None:
            seen = seen.unionByName(best).distinct()
        nearest = Window.partitionBy("query").orderBy("distance")
        seen = seen.withColumn("before", F.sum("n").over(nearest) - F.sum("n").over(Window.partitionBy("query", "distance")))
        kept = common.stored(seen.filter(F.col("before") < k).select("query", "code", "distance", "n"), "nearest")
        reach = kept.groupBy("query").agg(F.when(F.sum("n") >= k, F.max("distance")).alias("far"))
        covered = SEGMENTS * (radius + 1) - 1
        state = open_.join(reach, "query", "left")
        still = common.stored(state.filter(F.col("far").isNull() | (F.col("far") > covered)).select("query", F.coalesce("far", F.lit(BITS)).alias("bound")), "open-queries")
        if radius == WIDTH:
            still = still.limit(0)
        finished = kept.join(still.select("query"), "query", "left_anti")
        done = finished if done is None else done.unionByName(finished)
        best = kept.join(still.select("query"), "query", "left_semi")
        open_ = still
    if done is None:
        return queries.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("distance"))
    flat = done.join(entries, "code").select("query", "distance", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy("distance", F.col("vec_id").asc_nulls_last())
    ranked = common.stored(flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "ranked")
    return queries.join(ranked, queries.code == ranked["query"]).select(F.col("id").alias("query_id"), "rank", "vec_id", "distance")


def op9_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest codes of every vector whose id is divisible by 50, among all vectors, itself included. Null vectors are no
    part of it; short ones, ties and repeated rows as in ``codes`` and ``top_k``; further columns, whatever their names, play no
    part."""
    rows = codes(common.table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("id") % EVERY == 0))


OP9_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x >= 0, false)) AS b FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.b[i] IS DISTINCT FROM e.b[i] THEN 1 ELSE 0 END))::BIGINT AS distance FROM c q, c e WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10
"""
