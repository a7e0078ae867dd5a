"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.storage import Workspace


def connected_components(links: DataFrame, space: Workspace) -> DataFrame:
    """``links`` (a, b: bigint) -> (node, component): the smallest node reachable.

    Only nodes with a link to another node are listed.  Each round hangs the larger neighbours of a
    node, then the smaller ones, on its smallest neighbour; the smallest neighbour comes from an
    aggregation with map-side combine and is joined back, so a node with very many links is
    neither gathered nor unsplittable.  Rounds are cut with written tables; only two numbers a round
    reach the driver.
    """
    edges = space.cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .where("a <> b").distinct())
        lower = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(lower, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .union(lower.select("a", F.col("low").alias("b")))
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        after = space.cut(small, "links")
        space.drop(edges)
        edges = after
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
