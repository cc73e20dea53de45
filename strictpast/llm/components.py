"""Connected components of an edge table by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b) with a > b.

    Large: every larger neighbour of a node links to the smallest of the node and its neighbours.
    Small: every smaller neighbour, and the node, link to the smallest neighbour.
    The minimum is a map-side-combined aggregate; the join back is a merge join, which adaptive execution
    splits where a hub owns many edges; a broadcast would gather in the driver what grows with the input.
    """
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = near.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least.hint("merge"), "a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Self-links and null ends are ignored; repeated links count once; an empty table gives an empty result.
    Every round is written to the shared folder, so a lost executor repeats one round at most.
    """
    ordered = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = written(ordered, "links"), None
    for _ in range(max_rounds):
        now = written(_star(_star(now, True), False), "links")
        count, mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == (count, mark):
            break
        before = (count, mark)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
