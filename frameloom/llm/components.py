"""Connected components of an edge table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _signature(edges: DataFrame) -> tuple:
    """Changes when the set of edges does: a count and two sums of 31-bit hashes, which can't overflow."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(0x7FFFFFFF)).alias("a"), F.sum(F.shiftrightunsigned(h, 33)).alias("b")).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` has long columns u and v, in any direction. Returns u and root: the smallest member
    of u's component, for every u that isn't one itself.

    Alternates two steps (large star: greater neighbours to the least one; small star: lesser
    neighbours to the least one) until every node points at its root. Per node only a minimum is
    aggregated, in part before the shuffle; the edges follow by an equi-join that adaptive execution
    may split where a node has very many. Each round's edges are checkpointed.
    """
    oriented = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = cut(oriented.distinct())
    before = _signature(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select("u", F.col("v").alias("root"))
