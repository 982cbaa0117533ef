"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solarweave.storage import Stored


def _star(pairs: DataFrame, large: bool) -> Stored:
    """One star step over (u, v) with u > v, written to the shared folder.

    Each step is a map-side combined minimum and one equi-join back. The minima are written
    before the join (see storage.joined_back), so adaptive execution splits a node with very
    many neighbours over several tasks.
    """
    around = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = Stored(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
    joined = around.join(least.df, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.df.select("u", F.col("m").alias("v")))
    done = Stored(out.filter(F.col("u") != F.col("v")).distinct(), "edges")
    least.drop()
    return done


def _settled(pairs: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: all components are stars."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.filter("up + down > 1 and up > 0").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    Null ends and self loops are ignored, repeated and reversed edges count once; an empty
    input gives an empty result. Any orderable type serves as node. Every step is written
    to the shared folder, so none is recomputed after a lost executor. Raises if
    max_rounds is not enough (a chain of n nodes takes about log2(n) rounds).
    """
    whole = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = Stored(whole.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now.df):
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        after = _star(now.df, True)
        now.drop()
        now = _star(after.df, False)
        after.drop()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
