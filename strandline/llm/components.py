"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs each node's larger (or smaller) neighbours under its smallest one.

    The minimum is a partial aggregate and the join can be split on a hot node, so no node's
    neighbours are gathered in one task.
    """
    u, v = F.col("u"), F.col("v")
    if large:
        edges = edges.select("u", "v").union(edges.select(v.alias("u"), u.alias("v")))
        low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = edges.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(low, "u").select(v.alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return hung.where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node hangs under two others, or under one that hangs itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("v", F.lit(0), F.lit(1)).distinct())
    return ends.groupBy("x").agg(F.sum("hangs").alias("a"), F.max("holds").alias("b")).where("a > 1 or (a = 1 and b = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Null ends and self-loops are ignored; repeated edges count once; an empty table gives an empty result. Every
    round is written to the shared folder. Raises if the rounds run out, which no real graph does.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.where((u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    now = scratch.write(now, "edges")
    for _ in range(rounds):
        new = scratch.write(_star(_star(now, True), False), "star")
        scratch.drop(now)
        now = new
        if _settled(now):
            return now.select(u.alias("node"), v.alias("component")).union(now.select(v.alias("node"), v.alias("component")).distinct())
    raise RuntimeError("components did not settle")
