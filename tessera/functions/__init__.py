"""The st_* functions of a session.

``register(spark)`` adds all of them as temporary functions, for SQL and for
``F.call_function``. A name without suffix takes GEOMETRY (WKB); a suffix names a
columnar type. ``st(df, name, *columns)`` picks the suffix from the column types."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..jts import build, spec
from ..shipping import ship
from . import native

_SUFFIX = {"struct<x:double,y:double>": "point2d", "array<struct<x:double,y:double>>": "linestring2d", "array<array<struct<x:double,y:double>>>": "polygon2d", "struct<min_x:double,min_y:double,max_x:double,max_y:double>": "box2d", "struct<min_x:float,min_y:float,max_x:float,max_y:float>": "box2df"}
#: SQL aggregates over GEOMETRY
AGGREGATES = ("st_extent_agg", "st_envelope_agg", "st_union_agg", "st_intersection_agg")
_ALIASES = {"st_within_point2d_polygon2d": "st_within_point2d", "st_contains_polygon2d_point2d": "st_contains_polygon2d", "st_distance_point2d_point2d": "st_distance_point2d", "st_intersects_box2d_box2d": "st_intersects_box2d", "st_numpoints": "st_npoints", "st_numinteriorrings": "st_ninteriorrings"}


def names() -> list[str]:
    return sorted({n for n, *_ in spec.FUNCTIONS if n[0] != "_"} | set(native.FUNCTIONS) | set(AGGREGATES))


def register(spark: SparkSession) -> SparkSession:
    """Registers all functions in the session; again is harmless."""
    ship(spark)
    if getattr(spark, "_tessera_functions", False):
        return spark
    jar = build.JAR if os.path.exists(build.JAR) else build.build()
    spark.sql(f"ADD JAR '{jar}'")
    for name, _, result, _ in spec.FUNCTIONS:
        spark.udf.registerJavaFunction(name, f"tessera.Udfs${spec.class_name(name)}", _parse_datatype_string(result))
    _register_aggregates(spark)
    for name in native.ORDER:
        params, result, body = native.FUNCTIONS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    spark._tessera_functions = True
    return spark


def _register_aggregates(spark: SparkSession) -> None:
    """The aggregates are registered by their own class."""
    kernels(spark, "Aggregates").accept(spark._jsparkSession)


def kernels(spark: SparkSession, name: str):
    """An object of a class of the kernels, which the loader of added jars finds, on the driver."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    loader = spark._jsparkSession.sharedState().jarClassLoader()
    return loader.loadClass(f"tessera.{name}").getDeclaredConstructor(array(jvm.java.lang.Class, 0)).newInstance(array(jvm.java.lang.Object, 0))


def st(df: DataFrame, name: str, *args: Column | str) -> Column:
    """The function ``name`` applied to columns (names or Columns) of df, by their types."""
    columns = [F.col(a) if isinstance(a, str) else a for a in args]
    kinds = [f.dataType.simpleString() for f in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).schema]
    suffixes = [_SUFFIX[k] for k in kinds if k in _SUFFIX]
    full = "_".join([name.lower(), *suffixes])
    known = set(names())
    for candidate in (full, _ALIASES.get(full), "_".join([_ALIASES.get(name.lower(), name.lower()), *suffixes]), "_".join([name.lower(), *suffixes[:1]]), name.lower()):
        if candidate in known:
            return F.call_function(candidate, *columns)
    raise ValueError(f"no function {name} for {', '.join(kinds)}")


def documentation() -> list[tuple[str, str, str]]:
    """Name, parameters and result of each function."""
    codes = {"g": "GEOMETRY", "d": "DOUBLE", "i": "INT", "n": "BIGINT", "s": "STRING", "b": "BOOLEAN", "l": "ARRAY<GEOMETRY>", "p": "POLYGON_2D", "r": "STRUCT"}
    jvm = [(n, ", ".join(codes[a] for a in args), "GEOMETRY" if out == "binary" else out.upper()) for n, args, out, _ in spec.FUNCTIONS if n[0] != "_"]
    jvm += [(n, "GEOMETRY", "GEOMETRY (aggregate)") for n in AGGREGATES]
    return sorted(jvm + [(n, re.sub(r"\s+", " ", p), r) for n, (p, r, _) in native.FUNCTIONS.items()])
