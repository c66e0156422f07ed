"""Connected components over edge tables, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones and itself) to the least of them."""
    if large:
        seen = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return seen.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    both = edges.join(least, "u")
    return both.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, label: str = "components", rows: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge: the least node that can be reached.

    edges: columns a, b (bigint, a != b; nulls are ignored); rows: a bound on their number, if known. Each step is written to the shared folder.
    Stops when a pair of steps leaves the edges as they were; no edge ever comes to the driver.
    """
    now = written(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label, rows)
    state = None
    while True:
        # A step leaves no more edges than it found, and at most one for each node besides.
        now = written(_star(_star(now, True), False), label, rows and 2 * rows)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
