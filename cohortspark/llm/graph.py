"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.session import materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m the least of u and its neighbours v. The minimum is a partial aggregate and the join can be split,
    so a node with a third of all edges is not gathered."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    known = _with_least(edges)
    return known.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(known.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without edges are absent.

    ``edges`` has columns a, b of one orderable type. Every round is written to the shared folder; rounds grow
    with the logarithm of the longest chain, and the loop ends when a round changes nothing."""
    tidy = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    current = materialize(tidy(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    before = state(current)
    while before[0]:
        current = materialize(tidy(_small_star(tidy(_large_star(current)))))
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
