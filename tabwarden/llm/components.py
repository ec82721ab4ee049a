"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.tables import written_with


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, root): root is the smallest node reachable from node, for all nodes in an edge.

    Every step sends a node's neighbours to the smallest of them, so that trees get flat in a number of
    steps that grows with the logarithm of their depth.  A step's table is written to the shared folder;
    the loop ends when a step finds nothing to move.
    """

    def small(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def to_least(e: DataFrame) -> DataFrame:
        """(a, b, low): each edge with the smallest neighbour of a, itself included."""
        return e.join(e.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "a")

    def step(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = to_least(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"), (F.col("low") < F.col("a")).alias("moved"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a").withColumn("moved", F.col("moved") | (F.col("b") != F.col("low")))
        # an edge to the smallest neighbour stays, the others lead from neighbour to neighbour
        out = joined.select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"), "moved")
        return out.groupBy("a", "b").agg(F.max("moved").alias("moved"))

    now, _ = written_with(small(edges), "edges")
    while True:
        now, seen = written_with(step(now), "edges", F.coalesce(F.max("moved"), F.lit(False)).alias("moved"))
        now = now.select("a", "b")
        if not seen["moved"]:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
