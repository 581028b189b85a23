"""Connected components by alternating stars; edges never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import written


def _sum(edges: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` pairs but the roots, the smallest reachable nodes.

    A large star ties a node's larger neighbours to its smallest one, a small star its smaller ones;
    alternating them leaves one star per component after a logarithmic number of rounds. A round
    is two joins on the node (a hub is split by the skew join) and two pre-aggregated minima. The
    edges are written to shared storage each round. Self-loops and repeated pairs change nothing.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where("a <> b").distinct(), "edges")
    seen = _sum(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        latest = _sum(now)
        if latest == seen:
            break
        seen = latest
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
