"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkfold.llm.common import dropped, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node) for each node of edges (a, b bigint).

    A step joins each node to the least node around it. Hubs are reduced by partial aggregation before the shuffle, and
    the join that follows can be split by the engine; no node's neighbours are gathered. Ends when a round changes nothing.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    current, state = stored(pairs, "edges"), None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        own = down.select(F.col("m").alias("a"), "b")
        small = large.join(down, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(own).distinct()
        following = stored(small, "edges")
        now = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(current)
        current = following
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    tops = current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(tops)
