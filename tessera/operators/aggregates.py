"""Spatial aggregates. All combine map-side: bounds as minima and maxima, unions and
intersections of bounded parts first and of the parts' results then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import register

#: Geometries that a first-level union takes at most about, so that no task gathers a whole group.
PART = 512


def extent_agg(geom: Column | str) -> tuple[Column, Column, Column, Column]:
    """Min x, min y, max x, max y of a group's geometries (float bounds, as st_extent gives them); native minima and maxima."""
    box = F.call_function("st_extent", F.col(geom) if isinstance(geom, str) else geom)
    return F.min(box["min_x"]).alias("min_x"), F.min(box["min_y"]).alias("min_y"), F.max(box["max_x"]).alias("max_x"), F.max(box["max_y"]).alias("max_y")


def extent_of(df: DataFrame, keys: list[str], geom: str, out: str = "extent") -> DataFrame:
    """st_extent_agg: the envelope polygon of each group, null where no geometry has bounds."""
    register(df.sparkSession)
    boxed = df.groupBy(*keys).agg(*extent_agg(geom))
    return boxed.select(*keys, F.call_function("st_makeenvelope", "min_x", "min_y", "max_x", "max_y").alias(out))


def _fold(df: DataFrame, keys: list[str], geom: str, out: str, function: str, order: str | None) -> DataFrame:
    """Salted two-level fold of a function over arrays of geometries: what a task gathers is bounded by PART at the first
    level; the number of parts of a group is bounded by further levels until one is left."""
    register(df.sparkSession)
    rows = df.select(*keys, F.col(geom).alias("_g")).filter("_g is not null").distinct()  # neither function minds repeats
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    key = F.call_function("st_hilbert_world", "_g") if order == "hilbert" else F.xxhash64("_g")
    rows = rows.withColumn("_h", F.coalesce(key, F.lit(0).cast("long")))
    while largest > PART:
        parts = -(-largest // PART)
        rows = rows.withColumn("_p", F.pmod(F.xxhash64("_h", "_g"), F.lit(parts)))
        rows = rows.groupBy(*keys, "_p").agg(F.call_function(function, F.collect_list("_g")).alias("_g"), F.min("_h").alias("_h"))
        largest = parts
    return rows.groupBy(*keys).agg(F.call_function(function, F.collect_list("_g")).alias(out))


def union_agg(df: DataFrame, keys: list[str], geom: str, out: str = "union") -> DataFrame:
    """st_union_agg: cascaded union of each group; groups without geometries give no row."""
    return _fold(df, keys, geom, out, "st_union_list", "hilbert")


def intersection_agg(df: DataFrame, keys: list[str], geom: str, out: str = "intersection") -> DataFrame:
    """st_intersection_agg: intersection of each group."""
    return _fold(df, keys, geom, out, "st_intersection_list", None)


def collect_agg(df: DataFrame, keys: list[str], geom: str, out: str = "collection") -> DataFrame:
    """st_collect over a group: one value that holds all of the group's geometries."""
    register(df.sparkSession)
    return df.groupBy(*keys).agg(F.call_function("st_collect", F.collect_list(geom)).alias(out))


def makeline_agg(df: DataFrame, keys: list[str], point: str, order: str, out: str = "line") -> DataFrame:
    """A POINT_2D column to a LINESTRING_2D by order, for each group; the line is one value."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(point).alias("p"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda s: s["p"]).alias(out))
