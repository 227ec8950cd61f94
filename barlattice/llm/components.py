"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import discard, materialise


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: a, b long. Returns node, root: each node that has an edge to another node, and the smallest node it is connected to.

    Links stay in tables; the driver sees one count and one checksum a round. Every round is written to the
    shared folder, so the lineage is one round long. Self loops and repeated edges are fine; no edges, no rows.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _summary(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # written first: the join below then has plain shuffles on both sides, which Spark can split where a hub is hot
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        after = materialise(small, "edges")
        discard(now)
        discard(least)
        now, seen = after, _summary(after)
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    star = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return star.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
