"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mins(directed: DataFrame) -> DataFrame:
    """The least of each node and its neighbours; written, so that a join with it can be split where a node is hot."""
    return stored(directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc-min", "lz4")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b) can reach.

    Nothing but counts and a checksum comes to the driver. A round is two aggregations and
    two joins; their number grows with the logarithm of the nodes. Self-loops are dropped.
    """
    cur = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "cc", "lz4")

    def state(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    seen = state(cur)
    for _ in range(rounds):
        if not seen[0]:
            break
        # large-star: each larger neighbour goes to the least one
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(both.filter("v > u").join(_mins(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "cc", "lz4")
        # small-star: each smaller neighbour, and the node, go to the least one
        small = large.join(_mins(large), "u")
        cur = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "cc", "lz4")
        now = state(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components didn't settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
