"""Readers by file name, writers, and the lists of drivers and reference systems."""

from __future__ import annotations

import itertools
import json
import os
import re
import sqlite3
import struct
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions
from ..shared import drop, remove, settle, shared_path
from . import files, osm, shapefile

DRIVERS = [
    ("GeoJSON", "GeoJSON feature collections", True, (".geojson", ".json", ".geojson.gz")),
    ("GeoJSONSeq", "Newline-delimited GeoJSON features", True, (".geojsonl", ".geojsons", ".ndjson", ".geojsonl.gz")),
    ("ESRI Shapefile", "ESRI shapefile", True, (".shp",)),
    ("GPKG", "GeoPackage", False, (".gpkg",)),
    ("OSM", "OpenStreetMap PBF", False, (".osm.pbf", ".pbf")),
    ("CSV", "CSV with WKT", True, (".csv", ".csv.gz")),
    ("Parquet", "Parquet with WKB", True, (".parquet",)),
]


#: Bytes of a GeoJSON document's range, records of a shapefile's, bytes of a partition that the driver takes at a time.
STEP, RECORDS, PART = 1 << 20, 4096, 8 << 20

_BOX, _POINT = "STRUCT<min_x:DOUBLE,min_y:DOUBLE,max_x:DOUBLE,max_y:DOUBLE>", "STRUCT<x:DOUBLE,y:DOUBLE>"
_UNIT = "pmod(xxhash64(id, seed, '{0}'), 4503599627370496) / 4503599627370496D"
_GENERATE = f"""CREATE OR REPLACE TEMPORARY FUNCTION st_generatepoints(box {_BOX}, n BIGINT, seed BIGINT DEFAULT 0) RETURNS TABLE(point {_POINT}) RETURN
 SELECT named_struct('x', box.min_x + {_UNIT.format("x")} * (box.max_x - box.min_x), 'y', box.min_y + {_UNIT.format("y")} * (box.max_y - box.min_y))
 FROM (SELECT 1 AS one) LATERAL VIEW explode(sequence(0L, IF(n < 0, raise_error('the number of points must not be negative'), n) DIV 65536)) c AS chunk
 LATERAL VIEW explode(sequence(chunk * 65536, chunk * 65536 + 65535)) i AS id WHERE id < n"""


def register(spark: SparkSession) -> SparkSession:
    """All functions of the session, with the table functions st_generatepoints, st_drivers and st_list_proj_crs."""
    functions.register(spark)
    if not getattr(spark, "_tessera_tables", False):
        spark.sql(_GENERATE)
        for name, df in (("st_drivers", st_drivers(spark)), ("st_list_proj_crs", st_list_proj_crs(spark))):
            columns = ", ".join(f"{c} {k}" for c, k in df.dtypes)
            literal = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "\\'") + "'"
            rows = ", ".join("(" + ", ".join(f"CAST({literal(v)} AS {k})" for v, (_, k) in zip(r, df.dtypes, strict=True)) + ")" for r in df.collect())
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS TABLE({columns}) RETURN SELECT * FROM VALUES {rows}")
        spark._tessera_tables = True
    return spark


def driver_of(path: str) -> str:
    found = [(len(s), name) for name, _, _, suffixes in DRIVERS for s in suffixes if path.lower().rstrip("/").endswith(s)]
    if not found:
        raise ValueError(f"no driver for {path}; supported: {', '.join(d[0] for d in DRIVERS)}")
    return max(found)[1]


def st_read(spark: SparkSession, path: str, layer: str | int | None = None, driver: str | None = None, allowed_drivers: list[str] | None = None, keep_wkb: bool = False, bbox: tuple | None = None, spatial_filter: bytes | None = None, columns: list[str] | None = None, encoding: str | None = None, wkt_column: str = "geom") -> DataFrame:
    """Rows of a file with the column geom (wkb_geometry if keep_wkb), of a box (bbox) or of a geometry's bounds, if given."""
    register(spark)
    driver = driver or driver_of(path)
    if allowed_drivers and driver not in allowed_drivers:
        raise ValueError(f"driver {driver} is not allowed")
    if bbox is not None and spatial_filter is not None:
        raise ValueError("give a box or a geometry to filter by, not both")
    df = {"GeoJSON": lambda: _geojson(spark, path), "GeoJSONSeq": lambda: _geojson_lines(spark, path), "ESRI Shapefile": lambda: _shapefile(spark, path, encoding), "GPKG": lambda: _gpkg(spark, path, layer), "OSM": lambda: read_osm(spark, path), "CSV": lambda: _csv(spark, path, wkt_column), "Parquet": lambda: spark.read.parquet(path)}[driver]()
    if spatial_filter is not None:
        b = spark.createDataFrame([(bytearray(spatial_filter),)], "g binary").select(F.call_function("st_extent", "g").alias("b")).first()["b"]
        bbox = tuple(b) if b else (0.0, 0.0, -1.0, -1.0)
    if bbox is not None:
        b = F.call_function("st_extent", "geom")
        df = df.filter((b["min_x"] <= bbox[2]) & (b["max_x"] >= bbox[0]) & (b["min_y"] <= bbox[3]) & (b["max_y"] >= bbox[1]))
    if columns:
        df = df.select(*columns, *[c for c in ("geom",) if c in df.columns and c not in columns])
    return df.withColumnRenamed("geom", "wkb_geometry") if keep_wkb and "geom" in df.columns else df


def _unique(names: list[str]) -> list[str]:
    """Unnamed columns get v<i>, repeated ones (whatever their case) a number."""
    out, seen = [], {}
    for i, n in enumerate(names):
        n = n or f"v{i}"
        k = n.lower()
        seen[k] = seen.get(k, 0) + 1
        out.append(n if seen[k] == 1 else f"{n}_{seen[k] - 1}")
    return out


def _features(raw: DataFrame) -> DataFrame:
    """Feature texts (column f) to properties and geom; the properties' types are those of all features."""
    fields = raw.select(F.get_json_object("f", "$.properties").alias("p"), F.get_json_object("f", "$.geometry").alias("g"))
    found = raw.sparkSession.read.json(fields.select("p").filter("p is not null").rdd.map(lambda r: r[0])).schema  # what is inferred is the schema only
    geom = F.call_function("st_geomfromgeojson", "g").alias("geom")
    if not len(found.fields):
        return fields.select(geom)
    return fields.select(F.from_json("p", found).alias("p"), "g").select("p.*", geom)


def _geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    return _features(spark.read.text(path).select(F.regexp_replace("value", "^\u001e", "").alias("f")).filter("trim(f) <> ''"))


def _geojson(spark: SparkSession, path: str) -> DataFrame:
    """One pass finds where a collection's features may be cut; then a task parses about a megabyte at a time. Other
    documents (one feature or geometry, compressed ones) are parsed whole, each by one task."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0).to_pylist():
                doc = json.loads(text)
                found = doc.get("features", []) if doc.get("type") == "FeatureCollection" else [doc if doc.get("type") == "Feature" else {"properties": {}, "geometry": doc}]
                for at in range(0, len(found), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(f) for f in found[at : at + 1000]], pa.string())], ["f"])

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = json.loads("[" + data.decode().rstrip().removesuffix(",") + "]")
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(f) for f in found], pa.string())], ["f"])

    whole, ranges = [], []
    names = files.whole(spark, path).select("path")
    for r in names.select("path", F.when(~F.lower("path").endswith(".gz"), F.call_function("_st_file_cuts", "path", F.lit(STEP))).alias("cuts")).collect():
        if r.cuts is None:
            whole.append(r.path)
        else:
            ranges += [(r.path, a, b) for a, b in zip(r.cuts, r.cuts[1:], strict=False)]
    raw = files.dealt(spark, ranges, "path string, a bigint, b bigint").select(F.call_function("_st_file_range", "path", "a", "b").alias("data")).mapInArrow(cut, "f string")
    return _features(raw.union(spark.read.text(whole, wholetext=True).select("value").mapInArrow(run, "f string")) if whole else raw)


def _csv(spark: SparkSession, path: str, wkt: str) -> DataFrame:
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.withColumn("geom", F.call_function("st_geomfromtext", F.col(wkt).cast("string"))) if wkt in df.columns else df


def _side(path: str, suffix: str) -> str:
    return re.sub(r"(?i)\.shp$", suffix, path)


def _shapefile(spark: SparkSession, path: str, encoding: str | None) -> DataFrame:
    """A shapefile (or a glob of them): each file is a task."""
    if encoding is None:
        try:
            name = files.content(spark, _side(path, ".cpg")).decode().strip().lower()
            encoding = "iso-8859-1" if name in ("iso-8859-1", "iso8859-1", "latin1", "8859_1", "1252") else "utf-8"
        except Exception:
            encoding = "utf-8"
    if encoding not in ("utf-8", "iso-8859-1", "blob"):
        raise ValueError("encoding is utf-8, iso-8859-1 or blob")
    stem = lambda p: p.rpartition(".")[0]
    shp, dbf = ({stem(p): p for p in sorted(files.listed(spark, _side(path, x)))} for x in (".shp", ".dbf"))
    try:
        shx = {stem(p): (p, n) for p, n in files.listed(spark, _side(path, ".shx")).items()}
    except Exception:
        shx = {}
    heads = {k: files.head(spark, p, struct.unpack("<H", files.head(spark, p, 12)[8:10])[0]) for k, p in dbf.items()}
    own = shapefile.fields(heads[min(heads)])
    names = _unique([n for n, *_ in own] + ["geom"])
    kinds = [shapefile.spark_type(k, w, d, encoding) for _, k, w, d in own]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, [*kinds, "binary"], strict=True))
    ranges, whole = [], []
    for k in sorted(shp.keys() & dbf.keys()):
        n, start, size = struct.unpack("<IHH", heads[k][4:12])
        if k not in shx:
            whole.append(k)
            continue
        if (shx[k][1] - 100) // 8 != n:
            raise ValueError(f"{shp[k]} and {dbf[k]} differ in their numbers of records")
        ranges += [(shp[k], shx[k][0], dbf[k], i, min(n, i + RECORDS), start + i * size, start + min(n, i + RECORDS) * size, bytearray(heads[k])) for i in range(0, n, RECORDS)]

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            for s, d, h in zip(pdf["s"], pdf["d"], pdf["h"], strict=True):
                rows = [[*a, g] for a, g in zip(shapefile.records(bytes(h), bytes(d), encoding), shapefile.shapes(bytes(s), 0), strict=True)]
                yield pd.DataFrame(rows, columns=names, dtype=object)

    def run_whole(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            for s, d in zip(pdf["shp"], pdf["dbf"], strict=True):
                rows = [[*a, g] for a, g in zip(shapefile.attributes(bytes(d), encoding), shapefile.shapes(bytes(s)), strict=True)]
                yield pd.DataFrame(rows, columns=names, dtype=object)

    asked = files.dealt(spark, ranges, "shp string, shx string, dbf string, a bigint, b bigint, at bigint, end bigint, h binary")
    df = asked.select(F.call_function("_st_file_shapes", "shp", "shx", "a", "b").alias("s"), F.call_function("_st_file_range", "dbf", "at", "end").alias("d"), "h").mapInPandas(run, schema)
    if whole:  # without an index, records are found by reading all
        content = lambda found, suffix, name: files.whole(spark, [found[k] for k in whole]).select(F.regexp_replace("path", suffix, "").alias("stem"), F.col("content").alias(name))
        df = df.union(content(shp, "(?i)\\.shp$", "shp").join(content(dbf, "(?i)\\.dbf$", "dbf"), "stem").mapInPandas(run_whole, schema))
    return df


def shapefile_meta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, shape_type, bounds, count of shapefiles, by their headers and indexes."""
    register(spark)
    rows = []
    for r in files.whole(spark, path).select("path", F.call_function("_st_file_range", "path", F.lit(0), F.least("length", F.lit(100))).alias("head")).collect():
        kind, bounds = shapefile.header(bytes(r["head"]))
        rows.append((r["path"], shapefile.SHAPES.get(kind, "UNKNOWN"), bounds, _side(r["path"], ".shx")))
    sizes = files.listed(spark, [r[3] for r in rows]) if rows else {}
    box = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"
    return spark.createDataFrame([(n, t, b, (sizes[x] - 100) // 8) for n, t, b, x in rows], f"name string, shape_type string, bounds {box}, count int")


def _gpkg(spark: SparkSession, path: str, layer: str | int | None) -> DataFrame:
    """A layer of a GeoPackage: an SQLite database, which one task reads."""
    data = files.whole(spark, path)

    def opened(content: bytes, use):
        with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:  # SQLite needs a file; it lives no longer than this call
            f.write(content)
            f.flush()
            con = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
            try:
                return use(con)
            finally:
                con.close()

    def describe(con):
        layers = con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
        if not layers:
            raise ValueError("the GeoPackage has no layer")
        if isinstance(layer, int):
            if not 0 <= layer < len(layers):
                raise ValueError(f"there is no layer {layer}")
            found = layers[layer]
        else:
            found = next((x for x in layers if x[0] == layer), None) if layer else layers[0]
            if found is None:
                raise ValueError(f"there is no layer {layer!r}; layers: {', '.join(x[0] for x in layers)}")
        return found, con.execute(f'PRAGMA table_info("{found[0]}")').fetchall()

    (name, geom), columns = opened(bytes(data.first()["content"]), describe)
    kind = lambda t: "bigint" if re.match(r"(?i).*int", t) else "double" if re.match(r"(?i)real|double|float", t) else "boolean" if re.match(r"(?i)bool", t) else "binary" if re.match(r"(?i)blob", t) else "string"
    plain = [(c[1], kind(c[2])) for c in columns if c[1] != geom]
    names = _unique([*[n for n, _ in plain], "geom"])
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, [*[k for _, k in plain], "binary"], strict=True))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                select = ", ".join(f'"{n}"' for n in [*[n for n, _ in plain], geom])
                rows = opened(bytes(content), lambda con: con.execute(f'SELECT {select} FROM "{name}"').fetchall())
                yield pd.DataFrame([[*r[:-1], gpkg_wkb(r[-1])] for r in rows], columns=names, dtype=object)

    df = data.mapInPandas(run, schema)
    return df.withColumn("geom", F.call_function("st_geomfromwkb", "geom"))


def gpkg_wkb(blob: bytes | None) -> bytes | None:
    """The WKB in a GeoPackage's geometry, null where it is marked empty."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return None if blob[3] & 16 else bytes(blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :])


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """st_readosm: nodes, ways and relations. Blobs are cut out by one pass and decoded in parallel."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, (kind, blob) in enumerate(osm.blobs(content)):
                    if kind == "OSMData":
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([i], pa.int64()), pa.array([blob], pa.binary())], ["file", "i", "blob"])

    def decode(batches):
        import pandas as pd

        for pdf in batches:
            for blob in pdf["blob"]:
                found = list(osm.rows(osm.inflate(bytes(blob))))
                yield pd.DataFrame(found, columns=osm.COLUMNS, dtype=object)

    blobs = files.whole(spark, path).select("path", "content").mapInArrow(cut, "file string, i bigint, blob binary")
    return blobs.repartition("file", "i").mapInPandas(decode, osm.SCHEMA)


def st_write(df: DataFrame, path: str, driver: str, geom: str = "geom", srs: str | None = None, layer_name: str | None = None, geometry_type: str | None = None) -> None:
    """Writes a table with one geometry column (GEOMETRY or POINT_2D). Parts are written by tasks; of a GeoJSON document
    and a shapefile, which are one file, the driver strings the parts together."""
    register(df.sparkSession)
    if driver not in {d[0] for d in DRIVERS if d[2]}:
        raise ValueError(f"driver {driver!r} can't write")
    if df.schema[geom].dataType.simpleString().startswith("struct<x:"):
        df = df.withColumn(geom, F.call_function("st_geometry_point2d", geom))
    others = [c for c in df.columns if c != geom]
    for c in others:
        if df.schema[c].dataType.typeName() in ("struct", "map", "interval", "decimal") and driver != "Parquet":
            raise ValueError(f"column {c} has a type that {driver} doesn't hold")
    if geometry_type:
        wrong = df.filter(F.col(geom).isNotNull() & (F.call_function("st_geometrytype", geom) != geometry_type.upper())).take(1)
        if wrong:
            raise ValueError(f"a geometry is no {geometry_type}")
    if driver == "Parquet":
        df.write.mode("overwrite").parquet(path)
    elif driver == "CSV":
        df.withColumn(geom, F.call_function("st_astext", geom)).write.mode("overwrite").csv(path, header=True)
    elif driver == "GeoJSONSeq":
        df.select(_feature(geom, others).alias("value")).write.mode("overwrite").text(path)
    elif driver == "GeoJSON":
        head = f'{{"type":"FeatureCollection","name":{json.dumps(layer_name or os.path.basename(path).split(".")[0])},'
        head += f'"crs":{{"type":"name","properties":{{"name":{json.dumps(srs)}}}}},' if srs else ""
        texts = shared_path(df.sparkSession)
        df.select(_feature(geom, others).alias("value")).write.option("lineSep", ",\n").text(texts)
        files.put(df.sparkSession, path, (head + '"features":[\n').encode(), texts=texts, without=2, last=b"\n]}")
        remove(df.sparkSession, texts)
    else:
        _write_shapefile(df.select(geom, *others), path)


def _write_shapefile(df: DataFrame, path: str) -> None:
    """Tasks encode RECORDS rows at a time as if these were the first; then each piece gets its place, and the driver strings them together."""
    spark, names, kinds = df.sparkSession, df.columns[1:], [f.dataType.simpleString() for f in df.schema.fields[1:]]

    def encode(part: int, rows: Iterator) -> Iterator[tuple]:
        for seq in itertools.count():
            some = list(itertools.islice(rows, RECORDS))
            if not some:
                return
            try:
                n, shape, bounds, shp, shx, dbf = shapefile.piece([None if r[0] is None else bytes(r[0]) for r in some], [list(r[1:]) for r in some], names, kinds)
                yield part, seq, n, shape, list(bounds), bytearray(shp), bytearray(shx), bytearray(dbf), len(shp), None
            except ValueError as e:
                yield part, seq, len(some), 0, None, None, None, None, 0, str(e)

    pieces = settle(spark.createDataFrame(df.rdd.mapPartitionsWithIndex(encode), "part int, seq int, n int, shape int, bounds array<double>, shp binary, shx binary, dbf binary, size bigint, error string"))
    found = pieces.select("part", "seq", "n", "shape", "bounds", "size", "error").orderBy("part", "seq").collect()  # a row for each RECORDS rows
    for r in found:
        if r.error:
            raise ValueError(r.error)
    shapes = {r.shape for r in found} - {0}
    if len(shapes) > 1:
        raise ValueError("a shapefile holds one kind of shapes")
    boxes = [r.bounds for r in found if r.shape]
    bounds = [f(b[i] for b in boxes) for i, f in enumerate((min, min, max, max))] if boxes else None
    places, number, offset = [], 1, 50
    for i, r in enumerate(found):
        places.append((r.part, r.seq, i, number, offset))
        number, offset = number + r.n, offset + r.size // 2
    heads = shapefile.heads(shapes.pop() if shapes else 0, bounds, number - 1, 2 * offset - 100, names, kinds)
    at = pieces.join(F.broadcast(spark.createDataFrame(places, "part int, seq int, i bigint, number bigint, first bigint")), ["part", "seq"])

    def place(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            both = [shapefile.placed(bytes(s), bytes(x), int(n), int(o)) for s, x, n, o in zip(pdf["shp"], pdf["shx"], pdf["number"], pdf["first"], strict=True)]
            yield pd.DataFrame({"i": pdf["i"], "shp": [b[0] for b in both], "shx": [b[1] for b in both]})

    placed = at.select("i", "shp", "shx", "number", "first").mapInPandas(place, "i bigint, shp binary, shx binary")
    n, width = number - 1, struct.unpack("<H", heads[2][10:12])[0]
    for suffix, head, rows, last, size in ((".shp", heads[0], placed, b"", 2 * offset), (".shx", heads[1], placed, b"", 8 * n), (".dbf", heads[2], at, b"\x1a", width * n)):
        rows = rows.select("i", suffix[1:]).repartitionByRange(size // PART + 1, "i").sortWithinPartitions("i")
        files.put(spark, _side(path, suffix), head, rows.select(suffix[1:]), last)
    files.put(spark, _side(path, ".cpg"), b"UTF-8")
    drop(pieces)


def _feature(geom: str, others: list[str]) -> Column:
    properties = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("{}")
    return F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), F.coalesce(F.call_function("st_asgeojson", geom), F.lit("null")), F.lit("}"))


def st_read_meta(spark: SparkSession, path: str) -> DataFrame:
    """file_name, driver_short_name, driver_long_name, layers (name, feature_count, geometry_fields, fields)."""
    register(spark)
    layer = "struct<name:string,feature_count:bigint,geometry_fields:array<struct<name:string,type:string,crs:string>>,fields:array<struct<name:string,type:string>>>"
    rows = []
    for file in [r.path for r in files.whole(spark, path).select("path").collect()]:
        name = driver_of(file)
        df = st_read(spark, file)
        fields = [(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name != "geom"]
        kinds = [r[0] for r in df.select(F.call_function("st_geometrytype", "geom")).distinct().limit(2).collect() if r[0]] if "geom" in df.columns else []
        geoms = [("geom", kinds[0] if len(kinds) == 1 else "GEOMETRY", None)] if "geom" in df.columns else []
        stem = os.path.basename(file).split(".")[0]
        rows.append((file, name, next(d[1] for d in DRIVERS if d[0] == name), [(stem, df.count(), geoms, fields)]))
    return spark.createDataFrame(rows, f"file_name string, driver_short_name string, driver_long_name string, layers array<{layer}>")


def st_drivers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, d, w, w, True, None) for n, d, w, _ in DRIVERS], "short_name string, long_name string, can_create boolean, can_copy boolean, can_open boolean, help_url string")


def st_list_proj_crs(spark: SparkSession) -> DataFrame:
    functions.register(spark)
    text = spark.sql("SELECT _st_crs_table(0)").first()[0]
    rows = []
    for line in text.strip().split("\n"):
        code, name, kind = line.split("\t")
        rows.append((*code.split(":"), name, "GEOGRAPHIC_2D_CRS" if kind == "geographic" else "PROJECTED_CRS", False, None, None if kind == "geographic" else kind, "Earth"))
    return spark.createDataFrame(rows, "auth_name string, code string, name string, type string, deprecated boolean, area_name string, projection_method_name string, celestial_body_name string")
