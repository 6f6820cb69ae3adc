"""Spatial functions over streams: all functions are plain expressions, so they run in Structured Streaming as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_counts(events: DataFrame, ts: str, x: str, y: str, level: int, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events for each time window and map tile; a stream is watermarked, so late events are dropped after ``late``."""
    if events.schema[ts].dataType.typeName() == "timestamp_ntz" and events.isStreaming:  # watermarks need an instant; it is read in the session's time zone
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    tile = F.call_function("st_quadkey_xy", F.col(x).cast("double"), F.col(y).cast("double"), F.lit(level))
    return timed.groupBy(F.window(ts, width).alias("w"), tile.alias("tile")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "tile", "n")
