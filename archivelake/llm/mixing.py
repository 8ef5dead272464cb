"""Mixing sources to target weights with DataFrame functions alone.

1. Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``share`` of all words; none gets
   more than ``epochs`` times its own words, and what it can't take is shared again by weight. That is one water level:
   target = least(cap, weight * level).
2. Blocks. A source's documents are dealt to its shards by a seeded hash of doc_id and laid end to end in each shard, in
   seeded order. A shard's line is cut into equal blocks of about ``block`` words (they differ by one word at most).
3. Sainte-Laguë. All blocks that the mix draws are dealt to sources by highest quotients of their targets (counted in
   blocks), then each source's blocks to its shards by highest quotients of the shards' sizes, which gives integer quotas.
4. Selection. A shard's blocks are permuted by a seeded affine map; a quota of q out of n blocks draws each block q div n
   times and the first q mod n places of the permutation once more. A document takes the words of the blocks it lies in.

Highest quotients without a row for each block: at divisor D = votes / seats every entry gets round(v / D) seats, which are
the seats of the highest quotients, off the wanted number by at most half an entry each. Only the seats next to that
boundary (within 1 + entries / 2 * v / votes of it) are ranked to add or remove the difference, so the result is exact.

Rows for documents are narrow (id, source, size) and shuffled once, by (source, shard); a shard holds a bounded number of
words, so a hot source is many groups. Tables of sources and shards are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block and in a shard's line, at most about.
BLOCK, SHARD = 32, 1 << 20
#: Multipliers of the affine maps; primes above any number of blocks in a shard, so each is a permutation.
STEPS = (1_000_000_007, 1_000_000_009, 998_244_353, 1_000_000_021)


def spread(seed: int, *columns: Column) -> Column:
    """A seeded pseudo-random long of 0 or more."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 62) - 1))


def targets(sources: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with weight and target. The windows run over one row a source.

    level(i) is the water level if exactly the i sources of the lowest cap / weight are full; the right one is the first
    that does not overfill the next source. Sources without words are full at 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    out = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1))
    out = out.withColumn("cap", F.lit(float(epochs)) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    every, rising = Window.partitionBy(), Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
    before = {c: F.coalesce(F.sum(c).over(rising), F.lit(0.0)) for c in ("cap", "weight")}
    out = out.withColumn("level", (F.col("total") - before["cap"]) / (F.sum("weight").over(every) - before["weight"]))
    level = F.min(F.when((F.col("level") <= F.col("full_at")) & (F.col("level") >= 0), F.struct("full_at", "level"))).over(every)["level"]
    return out.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * level), "cap")).select("source", "source_size", "target")


def sainte_lague(votes: DataFrame, group: list[str], keys: list[str], vote: str, seats: str) -> DataFrame:
    """votes with quota: each group's seats (the same number in all its rows) dealt by highest quotients vote / (2k + 1).

    Ties go to the first by keys. Entries without votes get no seat.
    """
    within = Window.partitionBy(*group)
    out = votes.withColumn("_all", F.sum(vote).over(within)).withColumn("_n", F.count("*").over(within))
    exact = F.when(F.col("_all") > 0, F.col(vote) * F.col(seats) / F.col("_all")).otherwise(0.0)
    out = out.withColumn("_near", F.floor(exact + 0.5)).withColumn("_off", F.sum("_near").over(within) - F.col(seats))
    reach = F.ceil(F.when(F.col("_all") > 0, F.col("_n") / 2 * F.col(vote) / F.col("_all")).otherwise(0.0)) + 1
    lowest, highest = F.when(F.col("_off") > 0, F.greatest(F.lit(0), F.col("_near") - reach)).otherwise(F.col("_near")), F.when(F.col("_off") < 0, F.col("_near") + reach).otherwise(F.col("_near"))
    fixed = F.when(F.col(vote) > 0, F.col("_near")).otherwise(0)
    edge = out.filter((F.col("_off") != 0) & (F.col(vote) > 0)).withColumn("_seat", F.explode(F.when(highest > lowest, F.sequence(lowest, highest - 1))))
    place = Window.partitionBy(*group).orderBy(F.when(F.col("_off") > 0, 1).otherwise(-1) * F.col(vote) / (2 * F.col("_seat") + 1), *[F.col(k).asc_nulls_last() for k in keys], "_seat")
    edge = edge.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= F.abs("_off"))
    change = edge.groupBy(*keys).agg(F.sum(-F.signum("_off")).cast("long").alias("_change"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    joined = out.withColumn("_near", fixed).alias("a").join(change.alias("b"), on, "left")
    return joined.select(*[F.col(f"a.{c}") for c in votes.columns], (F.col("_near") + F.coalesce("_change", F.lit(0))).cast("long").alias("quota"))


def mix(docs: DataFrame, share: float = 1.5, epochs: int = 2, block: int = BLOCK, shard: int = SHARD, seed: int = 42, weights: tuple = WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target (its source's), taken, and source, draws = taken / size.

    Size is the number of words (null: 0). A null source is a source of its own, the last; a null id is an id of its own.
    Repeated rows each count. An empty table gives no rows; texts without words take none. Reruns agree: all choices hang
    on doc_id and seed. Other columns of docs are left out, whatever their names, but for those in keep, which come last.
    """
    words = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0))
    words = F.when(F.col("text").isNull(), 0).otherwise(words).cast("long")
    rows = common.stored(docs.select(F.col("doc_id"), F.col("source"), words.alias("size"), *[F.col(c).alias(f"_{c}") for c in keep]), "mix-sizes")

    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, epochs, weights)
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long"))
    sources = common.stored(sources, "mix-sources")

    placed = rows.alias("r").join(common.joinable(sources).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    placed = placed.select("doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", F.pmod(spread(seed, F.col("doc_id")), F.col("shards")).alias("shard"), *[f"_{c}" for c in keep])

    lines = placed.groupBy("source", "shard").agg(F.sum("size").alias("held"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    lines = lines.withColumn("blocks", F.when(F.col("held") > 0, F.greatest(F.lit(1), F.round(F.col("held") / block))).otherwise(0).cast("long"))
    lines = common.stored(lines, "mix-lines")

    of_source = lines.groupBy("source").agg(F.sum("blocks").alias("all_blocks"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    of_source = of_source.withColumn("vote", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("all_blocks")).otherwise(0.0))
    of_source = of_source.withColumn("seats", F.round(F.sum("vote").over(Window.partitionBy())).cast("long")).withColumn("_g", F.lit(0))
    of_source = sainte_lague(of_source, ["_g"], ["source"], "vote", "seats").select(F.col("source").alias("_source"), F.col("quota").alias("seats"))

    dealt = lines.join(common.joinable(of_source), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("vote", F.col("blocks").cast("double"))
    dealt = sainte_lague(dealt, ["source"], ["source", "shard"], "vote", "seats")
    dealt = dealt.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "held", "blocks", F.least("quota", epochs * F.col("blocks")).alias("quota"))

    line = Window.partitionBy("source", "shard").orderBy(spread(seed + 1, F.col("doc_id")), "doc_id", "size")
    laid = placed.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    laid = laid.join(common.joinable(dealt), F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))

    # block b holds the words from b * held div blocks on
    n, held, quota = F.col("blocks"), F.col("held"), F.col("quota")
    start = lambda b: F.floor(b * held / n)
    first, last = F.floor(F.col("begin") * n / held), F.floor((F.col("end") - 1) * n / held)
    step = F.element_at(F.array(*map(F.lit, STEPS)), F.pmod(spread(seed + 2, F.col("source"), F.col("shard")), F.lit(len(STEPS))).cast("int") + 1)
    turn = F.pmod(spread(seed + 3, F.col("source"), F.col("shard")), n)
    place = lambda b: F.pmod(b * step + turn, n)
    draws = lambda b: F.floor(quota / n) + F.when(place(b) < quota % n, 1).otherwise(0)
    part = lambda b: F.greatest(F.lit(0), F.least(start(b + 1), F.col("end")) - F.greatest(start(b), F.col("begin")))
    # one block more on either side: the division that finds first and last rounds
    reach = F.sequence(F.greatest(F.lit(0), first - 1), F.least(n - 1, last + 1))
    taken = F.when((F.col("size") > 0) & (n > 0), F.aggregate(reach, F.lit(0).cast("long"), lambda t, b: t + (part(b) * draws(b)).cast("long"))).otherwise(0)
    return laid.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", F.when(F.col("size") > 0, taken / F.col("size")).otherwise(0.0).alias("draws"), *[F.col(f"_{c}").alias(c) for c in keep])


def mixed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of docs as often as the mix draws them: the whole part of draws, and once more with a seeded chance of the rest.
    A row is found again by doc_id and a hash of its text; rows that repeat both share the sum of their draws."""
    hashed = docs.withColumn("__mix_h", F.xxhash64("text"))
    drawn = mix(hashed, seed=seed, keep=("__mix_h",))
    chance = spread(seed + 4, F.col("doc_id"), F.col("__mix_h")) / float(1 << 62)
    drawn = drawn.groupBy("doc_id", "__mix_h").agg(F.sum("draws").alias("draws"), F.count("*").alias("rows"))
    drawn = drawn.withColumn("copies", (F.floor("draws") + F.when(chance < F.col("draws") - F.floor("draws"), 1).otherwise(0)).cast("int")).filter("copies > 0")
    drawn = common.stored(drawn, "mix-draws").select(F.col("doc_id").alias("__mix_id"), F.col("__mix_h").alias("__mix_is"), F.col("copies").alias("__mix_n"), "rows")
    if not drawn.filter("rows > 1").isEmpty():
        hashed = common.one_of_each(hashed, ["doc_id", "__mix_h"])
    taken = hashed.join(drawn.drop("rows"), F.col("doc_id").eqNullSafe(F.col("__mix_id")) & (F.col("__mix_h") == F.col("__mix_is")))
    return taken.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), "__mix_n"))).select(*docs.columns)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of documents; nulls, ties, repeated rows, empty tables and further
    columns as in ``mix``."""
    return mix(common.table(spark, sf_dir, "documents"))
