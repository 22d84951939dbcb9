"""Connected components of distributed links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidstream.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) in; (node, component) out, the component being its smallest node.

    Links are never gathered: each step is an aggregate over nodes and a join. A node with very many
    links is reduced by partial aggregation and its join is split by adaptive execution. Nothing is
    broadcast, whatever its size: the loop would pile broadcasts up on the driver.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    state = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _large_star(edges):
    """Larger neighbours of each node go to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "node")
    return both.join(least.hint("merge"), F.col("a") == F.col("node")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges):
    """Smaller neighbours of each node, and the node, go to the smallest of them. ``a`` > ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
    joined = edges.join(least.hint("merge"), F.col("a") == F.col("node"))
    return joined.select("b", "m").where("b > m").withColumnRenamed("b", "a").withColumnRenamed("m", "b").unionByName(
        least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()
