"""st_generatepoints: uniform points in a box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_points(spark: SparkSession, box: tuple[float, float, float, float], n: int, seed: int = 0) -> DataFrame:
    """n rows of point (POINT_2D), the same for a seed however many partitions there are."""
    if n < 0:
        raise ValueError("the number of points must not be negative")
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed).cast("long"), F.lit(salt)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    x, y = box[0] + unit("x") * (box[2] - box[0]), box[1] + unit("y") * (box[3] - box[1])
    return spark.range(n).select(F.struct(x.alias("x"), y.alias("y")).alias("point"))
