"""Reading files through Spark's own file layer, so that every store works that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import functions

#: Ranges of a file that a task reads, each a row of about a megabyte.
RANGES = 16


def whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, length, content: one row a file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def content(spark: SparkSession, path: str) -> bytes:
    """The content of one small file (a header or a side file), by the driver."""
    rows = whole(spark, path).select("content").take(1)
    if not rows:
        raise FileNotFoundError(path)
    return bytes(rows[0][0])


def listed(spark: SparkSession, path: str | list[str]) -> dict[str, int]:
    """The lengths of the files, by path; none are read."""
    return {r.path: r.length for r in whole(spark, path).select("path", "length").collect()}


def head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first n bytes of a file, by the driver."""
    return bytes(functions.kernels(spark, "Files").read(path, 0, n))


def dealt(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that name ranges of files, dealt to tasks."""
    return spark.createDataFrame(rows, schema).repartition(max(1, -(-len(rows) // RANGES)))


def put(spark: SparkSession, path: str, first: bytes, rows: DataFrame | None = None, last: bytes = b"", texts: str = "", without: int = 0) -> None:
    """Writes one file: first, then the rows of one binary column (a partition at a time) or the files of the folder texts
    less the last bytes, then last. The driver holds no more than a partition or a buffer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(conf).create(where, True)
    try:
        out.write(bytearray(first))
        if rows is not None:
            functions.kernels(spark, "Files").appendRows(out, rows._jdf.toLocalIterator())
        if texts:
            folder = jvm.org.apache.hadoop.fs.Path(texts)
            store = folder.getFileSystem(conf)
            parts = jvm.java.util.ArrayList()
            for found in sorted((x.getPath() for x in store.listStatus(folder)), key=lambda x: x.getName()):
                if found.getName().startswith("part-"):
                    parts.add(found)
            functions.kernels(spark, "Files").appendFiles(out, store, parts, without)
        if last:
            out.write(bytearray(last))
    finally:
        out.close()
