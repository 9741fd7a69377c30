"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import drop, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> (node, root), root being the least node of the component.

    A round hangs each node's neighbours on the least of them, with an aggregation and a
    join, so a node with very many neighbours is never gathered in one place. Rounds end when
    the edges are stars; a path of n nodes takes about log n rounds. Each round is a written
    table. Nodes without an edge to another don't appear; null nodes are left out.
    """
    now = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # a node's smaller neighbours hang on the least of them, and so does it
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "edges")
        drop(now)
        now = new
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
