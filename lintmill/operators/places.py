"""Questions about places in a file: neighbours of a token, comments of a node, the innermost node at an offset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.plans.parsed import Tables


def with_neighbours(tokens: DataFrame) -> DataFrame:
    """Each token with the text, start and end of the tokens before and after it; one sort within a file."""
    w = W.partitionBy("path").orderBy("start")
    pick = F.struct("kind", "text", "start", "end")
    return tokens.withColumn("before", F.lag(pick).over(w)).withColumn("after", F.lead(pick).over(w))


def token_before(tokens: DataFrame, offsets: DataFrame) -> DataFrame:
    """(path, offset, token): the last token that ends at or before each of ``offsets(path, offset)``; null if none.

    As-of by one union and one running window, not by comparing all offsets with all tokens.
    """
    t = tokens.select("path", F.col("end").alias("at"), F.lit(0).alias("side"), F.struct("kind", "text", "start", "end").alias("token"), F.lit(None).cast("int").alias("offset"))
    o = offsets.select("path", F.col("offset").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(t.schema["token"].dataType).alias("token"), F.col("offset").cast("int").alias("offset"))
    w = W.partitionBy("path").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    return t.unionByName(o).withColumn("token", F.last("token", ignorenulls=True).over(w)).where("side = 1").select("path", "offset", "token")


def comments_inside(nodes: DataFrame, comments: DataFrame) -> DataFrame:
    """(path, node_id, text, start) of the comments within each node. The larger side is never broadcast: Spark takes what a parse gives for small."""
    c = comments.select("path", "text", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    return nodes.select("path", "node_id", F.col("start").alias("n_start"), F.col("end").alias("n_end")).hint("merge").join(c, "path").where("c_start >= n_start and c_end <= n_end").select("path", "node_id", "text", F.col("c_start").alias("start"))


def comments_inside_files(t: Tables, types: list[str]) -> DataFrame:
    """``comments_inside`` of the nodes of some types, in each file's own row: one parse, no shuffle."""
    n, c = F.col("n"), F.col("c")
    nodes = t.parsed.select("path", "comments", F.explode(F.filter("nodes", lambda x: x["type"].isin(*types))).alias("n"))
    inside = F.filter("comments", lambda x: (x["start"] >= n["start"]) & (x["end"] <= n["end"]))
    return nodes.select("path", n["node_id"].alias("node_id"), F.explode(inside).alias("c")).select("path", "node_id", c["text"].alias("text"), c["start"].alias("start"))


def innermost(nodes: DataFrame, offsets: DataFrame) -> DataFrame:
    """(path, offset, node_id, type): the smallest node around each of ``offsets(path, offset)``."""
    around = offsets.join(nodes.select("path", "node_id", "type", "start", "end", "depth"), "path").where("start <= offset and offset < end")
    return around.groupBy("path", "offset").agg(F.max_by(F.struct("node_id", "type"), F.struct("depth", "node_id")).alias("n")).select("path", "offset", "n.*")


def variables_in_scope(symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """(path, scope_id, name, symbol_id): for each scope the binding a name has there, the nearest winning."""
    from lintmill.operators.structure_rules import scope_ancestors

    own = scopes.select("path", "scope_id", F.col("scope_id").alias("above")).unionByName(scope_ancestors(scopes))
    depth = scopes.select("path", F.col("scope_id").alias("above"), "depth")
    seen = own.join(depth, ["path", "above"]).join(symbols.select("path", F.col("scope_id").alias("above"), "name", "symbol_id"), ["path", "above"])
    return seen.groupBy("path", "scope_id", "name").agg(F.max_by("symbol_id", F.struct("depth", -F.col("symbol_id"))).alias("symbol_id"))
