"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _with_min(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least neighbour of u. Least values combine before the shuffle, so a hub costs no more."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame, scratch: Scratch, rounds: int = 100) -> DataFrame:
    """Rows (node, component): for every node on an edge (a, b), the least node that it is linked with.

    Null ends and loops are left out; repeated edges change nothing. Each round is written out, so a lost executor costs
    a round at most.
    """
    now = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        linked = _with_min(large)
        small = linked.select("u", F.col("m").alias("v")).unionByName(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = scratch.table(small.distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
