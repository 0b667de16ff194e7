"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, unplaced


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node's larger (large star) or smaller (small star) neighbours,
    itself among the latter, are linked to its least neighbour or itself.

    A hub's neighbours are never gathered: the least comes from a partial
    aggregate, and the join back may be split where it is skewed."""
    if large:
        near = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    else:
        near = edges.select(F.col("b").alias("n"), F.col("a").alias("m"))
    least = near.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("root"))
    linked = near.join(least.withColumn("n", unplaced(F.col("n"))), "n")
    if large:
        out = linked.where("m > n").select(F.col("root").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("root").alias("a"), F.col("m").alias("b")).union(least.select(F.col("root").alias("a"), F.col("n").alias("b")))
    return out.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b), the label of each node that has any: node, root, where the
    root is the least node of its component and is itself left out."""
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        now = materialize(_star(_star(now, True), False), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = state
