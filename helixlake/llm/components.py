"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) but the roots, with the least node of its component.

    Each round points the neighbours of a node at their least one, first the larger, then the smaller.
    A component ends as one star around its least node. Edges and labels stay in Spark; minima are
    stored before they are joined, so that a root with very many neighbours can be split over tasks.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.where("m <> a").select("a", F.col("m").alias("b"))
        star = stored(large.unionByName(own).where("a <> b").distinct(), "large")
        lower = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(small.unionByName(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small")
        for old in (now, least, star):
            discard(old)
        # done when every node points at a root, once
        twice = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        chained = new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
        if twice.unionByName(chained).isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = new
