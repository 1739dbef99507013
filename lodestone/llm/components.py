"""Connected components of an edge table, by alternating large-star and small-star steps over shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours. The smallest ones are staged, so that
    the join stands alone and Spark may split a hub's links over tasks."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").union(least.select("a", F.col("least").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of one integer or string type. Gives (id, component) for every id with a link to another; the
    component is its smallest id. Self-links and nulls are dropped, repeated links count once. Nothing but two sums
    reaches the driver; each step is staged in the shared folder. The number of steps grows with the logarithm of the
    longest chain."""
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    while True:
        edges = staged(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
