"""Connected components of an edge table by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolary.sources.shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger neighbours (large) or the smaller ones and the vertex itself (small) onto the least neighbour.

    edges: a, b with a > b. The least neighbour is an aggregate with map-side combining; it comes back by a
    join, whose hot vertices adaptive execution can split.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("lo")).select(F.col("u").alias("x"), F.least("u", "lo").alias("m"))
    out = both.join(least, both.u == least.x)
    if large:
        out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select("v", "m").unionByName(least.select(F.col("x").alias("v"), "m")).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """vertex, root: the least vertex reachable, for every vertex with an edge to another one.

    Each round is checkpointed to the shared folder, so that a lost executor costs one round; rounds grow with the
    logarithm of the longest path. Loops and repeated edges are ignored.
    """
    now = cut(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = _state(now)
    while state[0]:
        now = cut(_star(_star(now, True), False))
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("root"))).distinct()
