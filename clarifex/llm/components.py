"""Connected components of a distributed edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarifex.llm.common import cut, skew_join


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of u, u itself included; hubs are not gathered in one task."""
    mins = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    return skew_join(edges, mins, ["u"], "n").select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns): root is the least node that it reaches.

    Links to itself, repeated and reversed links change nothing; null ends are dropped. Each round
    ends with a checkpoint. The number of rounds grows with the logarithm of the longest path.
    """
    a, b = edges.columns[:2]
    known = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v and u is not null and v is not null").distinct())
    before = None
    while True:
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _least(cut(large))
        known = cut(small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u != v").distinct())
        now = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = known.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return known.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = now
