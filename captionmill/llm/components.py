"""Connected components of an edge table, by alternating large-star and
small-star steps on DataFrames. Each step is written to the shared folder;
nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionmill.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v). Large-star joins the larger neighbours of
    a node to its least neighbour, small-star the smaller ones and itself.

    The least neighbour is found by an aggregate with partial sums and joined
    back; that join brings all edges of a node, as rows, to one task."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u long, v long), the
    component being its least node. Loops and null ends are left out; repeated
    edges and either direction are the same edge."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    told = mark(now)
    while told[0]:
        now = stored(_star(_star(now, True), False), "edges")
        new = mark(now)
        if new == told:
            break
        told = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
