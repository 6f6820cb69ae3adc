"""The layout that stands for a spatial index: rows in Hilbert order with their bounds
beside them, so that Parquet's minima and maxima skip files and row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import register
from ..operators.joins import bounds_of

BBOX = "bbox"


def with_bbox(df: DataFrame, geom: str, name: str = BBOX) -> DataFrame:
    """Adds the bounds as a struct of doubles, which Parquet stores with minima and maxima."""
    register(df.sparkSession)
    return df.withColumn(name, bounds_of(df, geom))


def cluster(df: DataFrame, geom: str, partitions: int) -> DataFrame:
    """Rows range-partitioned and sorted by the Hilbert code of their bounds' centre; null and empty geometries stand first."""
    boxed = with_bbox(df, geom)
    b = F.col(BBOX)
    e = boxed.agg(F.min(b["min_x"]).alias("a"), F.min(b["min_y"]).alias("b"), F.max(b["max_x"]).alias("c"), F.max(b["max_y"]).alias("d")).first()
    if e.a is None:
        return boxed
    frame = F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(e, ("min_x", "min_y", "max_x", "max_y"), strict=True)])
    code = F.call_function("st_hilbert_xy", (b["min_x"] + b["max_x"]) / 2, (b["min_y"] + b["max_y"]) / 2, frame)
    return boxed.withColumn("_h", code).repartitionByRange(partitions, "_h").sortWithinPartitions("_h").drop("_h")


def write_clustered(df: DataFrame, geom: str, path: str, partitions: int = 16) -> None:
    cluster(df, geom, partitions).write.mode("overwrite").parquet(path)


def window(df: DataFrame, box: tuple[float, float, float, float], exact: Column | None = None, name: str = BBOX) -> DataFrame:
    """Rows whose bounds meet the box (and for which exact holds): plain comparisons, which reach the scan."""
    b = F.col(name)
    met = df.filter((b["min_x"] <= box[2]) & (b["max_x"] >= box[0]) & (b["min_y"] <= box[3]) & (b["max_y"] >= box[1]))
    return met if exact is None else met.filter(exact)


def index_info(df: DataFrame, name: str = BBOX) -> DataFrame:
    """The bounds and row count of each partition: what an index would show as its leaves."""
    b = F.col(name)
    return df.groupBy(F.spark_partition_id().alias("leaf")).agg(F.min(b["min_x"]).alias("min_x"), F.min(b["min_y"]).alias("min_y"), F.max(b["max_x"]).alias("max_x"), F.max(b["max_y"]).alias("max_y"), F.count("*").alias("rows"))
