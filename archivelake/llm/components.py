"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step groups by a node for the smallest neighbour (pre-aggregated, so a hub costs a row a task) and joins that back;
the joined side has one row a node, so Spark can split a hub's rows among tasks. Every step is written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Links each node's larger (large) or smaller neighbours to the smallest of them and itself. few: there are so few edges
    that a row a node may be broadcast, so that a hub's rows stay where they are."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    out = both.join(F.broadcast(low) if few else low, "u")
    if large:
        return out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return out.filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v) of any one orderable type without nulls -> (node, component): each node that an edge names and the
    smallest node reachable from it. Loops and repeated edges are allowed; no edges give no rows.
    """
    state = common.stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    loops = edges.filter("u = v").select(F.col("u").alias("node"))
    seen = None
    for _ in range(rounds):
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == seen or not now[0]:
            break
        seen, before, few = now, state, 2 * now[0] <= common.BROADCAST_ROWS
        state = common.stored(_star(_star(state, True, few).filter("u <> v").distinct(), False, few).filter("u <> v").distinct(), "links")
        common.discard(before)
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    tree = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = tree.select("component").distinct().select(F.col("component").alias("node"), "component")
    known = tree.unionByName(roots)
    return known.unionByName(loops.distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("component")))
