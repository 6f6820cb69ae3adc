"""Makes this package importable on the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once for each context."""
    context = spark.sparkContext
    if not getattr(context, "_tessera_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tessera-py-"), "tessera.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("tessera", os.path.relpath(full, root)))
        context.addPyFile(path)
        context._tessera_shipped = True
    return spark
