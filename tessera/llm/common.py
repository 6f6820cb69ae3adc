"""What the operators of this subpackage share: reading tables and session settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop, settle, shared_dir
from ..shipping import ship

__all__ = ["ascii_lower", "count_words", "drop", "key_of", "settle", "shared_dir", "table", "tune"]

#: Rows that an Arrow batch holds at most; long texts make a larger batch too heavy for a Python worker.
BATCH_ROWS = 1000
#: Bytes of text that the numpy kernels take at once (about 40 bytes of arrays for each).
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches small, lets the planner split skewed joins, and makes sure that there is a checkpoint folder."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(doc_id: Column | str) -> Column:
    """doc_id as a key that is never null: null counts as the smallest."""
    return F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(-(2**63)).cast("long"))


def count_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of text, 0 for null; no array of words is made."""
    squeezed = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")
