"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in links (a, b).

    Each round points nodes at the smallest neighbour they know; paths halve, so rounds
    grow with the logarithm of the longest path. Every round is written to the shared
    folder. Joins are on nodes, and the side with a hub's many links can be split.
    Null ends, self links and repeats are ignored; no links, no rows.
    """
    edges = materialise(_star(links.select("a", "b").filter("a is not null and b is not null and a <> b")), "links")
    state = None
    while True:
        edges = materialise(_star(_star(edges, larger=True)), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component")).distinct()


def _star(edges: DataFrame, larger: bool = False) -> DataFrame:
    """Links (a, b) with a > b: each node's larger (or smaller) neighbours, and itself, to its least neighbour."""
    directed = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        directed = directed.filter("b < a")
    least = directed.groupBy("a").agg(F.min("b").alias("m"))
    least = least.withColumn("m", F.least("a", "m"))
    near = directed.filter("b > a") if larger else directed
    pointed = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        pointed = pointed.union(least.select("a", F.col("m").alias("b")))
    return pointed.filter("a <> b").distinct()
