"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: neighbours move to the least of their neighbourhood. The least is a
    map-side minimum, and the join back is one that the planner splits where a node is hot."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b); root is the
    least node reachable. Alternating large-star and small-star steps, each
    written to the shared folder, until no edge changes. Nodes are non-null
    longs; loops are dropped, no edges give no rows."""
    now = settle(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).alias("mark")
    seen = now.agg(mark).first()["mark"]
    while seen["n"]:
        old, now = now, settle(_star(_star(now, True), False))
        drop(old)
        was, seen = seen, now.agg(mark).first()["mark"]
        if was == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
