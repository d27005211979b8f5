"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("to").alias("key"), F.col("key").alias("to")))
    least = both.groupBy("key").agg(F.least(F.min("to"), F.first("key")).alias("least"))
    return both.where("to > key").join(least, "key").select(F.col("to").alias("key"), F.col("least").alias("to"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("key", "to").alias("key"), F.least("key", "to").alias("to"))
    least = down.groupBy("key").agg(F.min("to").alias("least"))
    joined = down.join(least, "key")
    return joined.select(F.col("to").alias("key"), F.col("least").alias("to")).unionByName(least.select("key", F.col("least").alias("to")))


def components(edges: DataFrame) -> DataFrame:
    """``key, to``: every node of ``edges`` (key, to) and the least node of its component.

    Alternating large and small stars until nothing changes, about log(n) times. A node with very
    many links is aggregated before the shuffle, and its rows are a skewed join that Spark
    can split. Self links and nulls are left out; no links give an empty table.
    """
    now = materialize(edges.where("key != to").select("key", "to").distinct(), "links")
    seen = None
    while True:
        now = materialize(_small_star(_large_star(now)).where("key != to").distinct(), "links")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("key", "to").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.unionByName(now.select(F.col("to").alias("key"), "to").distinct())
