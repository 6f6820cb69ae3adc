"""Tables in the folder that driver and executors share, which cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (tests on one machine) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_tessera_dir", None)
    if made is None:
        made = spark.sparkContext._tessera_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return made


def shared_path(spark: SparkSession, name: str = "") -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return f"{path}/{name}" if name else path


def settle(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so that later
    steps neither repeat the work nor depend on the executors that did it. The
    table goes when it is dropped, or else when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(settled: DataFrame) -> None:
    """Removes a table of settle that nothing unfinished reads any more."""
    remove(settled.sparkSession, settled._tessera_path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before
        pass
