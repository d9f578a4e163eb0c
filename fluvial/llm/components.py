"""Connected components of an edge table, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.llm.common import settle


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of (a, b): component is the least node that it reaches.

    Each round points every node at the least of its neighbourhood and then its neighbours there (large and
    small stars), which halves long paths, so rounds grow with the logarithm of the longest. The minimum is
    taken before the join, so a node with very many edges costs one row a partition there. Each round is
    written to the checkpoint folder; it ends when the edges stay the same. A small edge table is one
    partition and isn't shuffled.
    """
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    stars = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        for large in (True, False):
            near = stars.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.*") if large else stars
            least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
            joined = near.join(least, "u")
            # a neighbour goes to the least, and so does the node itself, once or more
            own = pair("u", "m")
            moved = F.when(F.col("v") > F.col("u") if large else F.col("v") != F.col("m"), pair("v", "m"))
            stars = joined.select(F.explode(F.array_compact(F.array(moved, own))).alias("e")).select("e.*").where("u <> v").distinct()
        stars = settle(stars)
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components didn't settle")
    return stars.select(F.explode(F.array(pair("u", "v"), pair("v", "v"))).alias("e")).groupBy(F.col("e.u").alias("node")).agg(F.min("e.v").alias("component"))
