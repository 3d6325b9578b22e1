"""Connected components of a graph in DataFrames, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut


def components(spark: SparkSession, links: DataFrame, name: str) -> DataFrame:
    """v, c: for every node of links (a, b) the least node that it is joined to, nodes that are least themselves included.

    Each step hangs the neighbours of a node on their least one; the least of a node's neighbours is an
    aggregate that is joined back, so a node with very many neighbours is split like any skewed join.
    """
    edges = cut(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(spark, large, f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = cut(spark, small, f"{name}-small")
        # done when every node hangs on one node, and none of these hangs on another
        tops = small.select(F.col("v").alias("u")).distinct()
        done = small.groupBy("u").count().filter("count > 1").isEmpty() and small.join(tops, "u", "left_semi").isEmpty()
        edges = small
        if done:
            break
    return edges.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(edges.select("v", F.col("v").alias("c")).distinct())
