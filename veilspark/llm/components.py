"""Connected components of a table of links, by alternating large and small stars.

Each round is two group-bys and joins over the links; labels and links stay in tables and never meet in one
place.  Rounds needed grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_once


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b.  Large: every node ties its larger neighbours to the least of its neighbourhood;
    small: its smaller ones and itself."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    tied = edges.join(least, "a")
    if large:
        out = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, one: str, other: str) -> DataFrame:
    """node, component (the least node) for every node with a link.  Links from a node to itself are none."""
    a, b = F.col(one), F.col(other)
    edges = write_once(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") > F.col("b")).distinct(), "edges")
    state = None
    while True:
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == tuple(sums) or not sums["n"]:
            break
        state = tuple(sums)
        new = write_once(_star(_star(edges, True), False), "edges")
        drop_table(edges)
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
