"""Connected components by alternating large-star and small-star rounds.

All rounds are joins and aggregates of edges; labels stay distributed, and each round is cut by a
reliable checkpoint. Rounds needed grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import cut


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(u, v)``; the label is the smallest node of the component.

    Self-loops are ignored; an empty table gives no rows. u and v need an ordering without nulls.
    """
    nodes_first = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = cut(nodes_first)
    seen = _signature(current)
    while seen[0]:
        current = cut(_small_star(_large_star(current)))
        now = _signature(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
