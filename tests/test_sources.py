"""Readers and writers: round trips, column rules, limits."""

import gzip
import json
import os
import sqlite3
import struct
import zlib

import pytest

from tessera import sources
from tessera.sources import dispatch, osm

ROWS = [(1, "a", 1.5, "POINT (1 2)"), (2, None, -2.0, "POINT (3 4)"), (3, "é", None, None)]
SHAPES = {
    "line": ["LINESTRING (0 0, 1 1)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))"],
    "polygon": ["POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "MULTIPOLYGON (((0 0, 0 1, 1 1, 1 0, 0 0)), ((2 2, 2 3, 3 3, 3 2, 2 2)))"],
    "multipoint": ["MULTIPOINT (0 0, 1 1)", None],
}


def table(spark, rows=ROWS):
    sources.register(spark)
    return spark.createDataFrame(rows, "id int, name string, value double, wkt string").selectExpr("id", "name", "value", "st_geomfromtext(wkt) AS geom")


def texts(df, *columns):
    return sorted((tuple(r) for r in df.selectExpr(*columns, "st_astext(geom) AS t").collect()), key=str)


@pytest.mark.parametrize(("driver", "name"), [("GeoJSON", "x.geojson"), ("GeoJSONSeq", "x.geojsonl"), ("ESRI Shapefile", "x.shp"), ("Parquet", "x.parquet"), ("CSV", "x.csv")])
def test_round_trip(spark, tmp_path, driver, name):
    path = str(tmp_path / name)
    sources.st_write(table(spark), path, driver)
    got = sources.st_read(spark, path)
    assert texts(got, "CAST(id AS INT)", "name", "CAST(value AS DOUBLE)") == sorted(ROWS, key=str)
    assert "wkb_geometry" in sources.st_read(spark, path, keep_wkb=True).columns
    assert texts(sources.st_read(spark, path, bbox=(0.0, 0.0, 2.0, 2.0), columns=["id"]), "CAST(id AS INT)") == [(1, "POINT (1 2)")]


@pytest.mark.parametrize("kind", SHAPES)
def test_shapefile_kinds(spark, tmp_path, kind):
    path = str(tmp_path / "s.shp")
    df = table(spark, [(i, "n", 0.5, w) for i, w in enumerate(SHAPES[kind])])
    sources.st_write(df, path, "ESRI Shapefile")
    assert texts(sources.st_read(spark, path), "CAST(id AS INT)") == sorted(((i, w) for i, w in enumerate(SHAPES[kind])), key=str)
    meta = dispatch.shapefile_meta(spark, path).first()
    assert meta["count"] == len(SHAPES[kind]) and meta.shape_type == {"line": "LINESTRING", "polygon": "POLYGON", "multipoint": "MULTIPOINT"}[kind]


def test_read_meta_and_limits(spark, tmp_path):
    path = str(tmp_path / "m.geojsonl")
    sources.st_write(table(spark), path, "GeoJSONSeq")
    with pytest.raises(ValueError):
        sources.st_read(spark, path, allowed_drivers=["CSV"])
    with pytest.raises(ValueError):
        sources.st_read(spark, path, bbox=(0, 0, 1, 1), spatial_filter=b"x")
    with pytest.raises(ValueError):
        sources.st_read(spark, str(tmp_path / "x.unknown"))
    with pytest.raises(ValueError):
        sources.st_write(table(spark), path, "OSM")
    with pytest.raises(ValueError):
        sources.st_write(table(spark), path, "GeoJSON", geometry_type="LINESTRING")
    one = str(tmp_path / "one.geojson")
    sources.st_write(table(spark), one, "GeoJSON", srs="EPSG:4326", layer_name="places")
    found = json.load(open(one))
    assert found["name"] == "places" and len(found["features"]) == 3 and found["crs"]["properties"]["name"] == "EPSG:4326"
    meta = sources.st_read_meta(spark, one).first()
    assert meta.driver_short_name == "GeoJSON" and meta.layers[0].feature_count == 3 and meta.layers[0].geometry_fields[0].type == "POINT"


def test_gzip_geojson(spark, tmp_path):
    sources.register(spark)
    path = tmp_path / "z.geojsonl.gz"
    path.write_bytes(gzip.compress(b'{"type":"Feature","properties":{"k":1},"geometry":{"type":"Point","coordinates":[1,2]}}\n'))
    assert texts(sources.st_read(spark, str(path)), "k") == [(1, "POINT (1 2)")]


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "p.gpkg")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    wkb = struct.pack("<BI2d", 1, 1, 5.0, 6.0)
    for layer, n in (("places", 2), ("more", 1)):
        con.execute(f"CREATE TABLE {layer} (fid INTEGER PRIMARY KEY, shape BLOB, label TEXT)")
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'shape')", (layer,))
        con.executemany(f"INSERT INTO {layer} VALUES (?, ?, ?)", [(i, b"GP\x00\x01" + struct.pack("<i", 4326) + wkb, f"{layer}{i}") for i in range(n)])
    con.commit()
    con.close()
    assert texts(sources.st_read(spark, path), "label") == [("places0", "POINT (5 6)"), ("places1", "POINT (5 6)")]
    assert texts(sources.st_read(spark, path, layer="more"), "label") == texts(sources.st_read(spark, path, layer=1), "label") == [("more0", "POINT (5 6)")]
    with pytest.raises(ValueError):
        sources.st_read(spark, path, layer="none")


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def zig(n):
    return (n << 1) ^ (n >> 63) if n >= 0 else ((-n) << 1) - 1


def packed(values):
    return b"".join(varint(v) for v in values)


def deltas(values):
    return packed([zig(b - a) for a, b in zip([0, *values], values, strict=False)])


def test_osm(spark, tmp_path):
    strings = field(1, b"".join(field(1, s) for s in (b"", b"name", b"x", b"outer")))
    dense = field(1, deltas([10, 12])) + field(8, deltas([515000000, 516000000])) + field(9, deltas([-1000000, 2000000])) + field(10, packed([1, 2, 0, 0]))
    way = field(1, 7) + field(2, packed([1])) + field(3, packed([2])) + field(8, deltas([10, 12, 10]))
    relation = field(1, 9) + field(8, packed([3, 0])) + field(9, deltas([7, 10])) + field(10, packed([1, 0]))
    block = strings + field(2, field(2, dense)) + field(2, field(3, way) + field(4, relation))
    blob = field(2, len(block)) + field(3, zlib.compress(block))
    data = b""
    for kind, body in ((b"OSMHeader", field(1, b"")), (b"OSMData", blob)):
        head = field(1, kind) + field(3, len(body))
        data += struct.pack(">I", len(head)) + head + body
    path = tmp_path / "m.osm.pbf"
    path.write_bytes(data)
    got = {(r.kind, r.id): r for r in sources.st_read(spark, str(path)).collect()}
    assert set(got) == {("node", 10), ("node", 12), ("way", 7), ("relation", 9)}
    assert got["node", 10].tags == {"name": "x"} and got["node", 12].tags is None
    assert got["node", 12].lat == pytest.approx(51.6) and got["node", 10].lon == pytest.approx(-0.1) and got["node", 10].refs is None
    assert got["way", 7].refs == [10, 12, 10] and got["way", 7].tags == {"name": "x"} and got["way", 7].lat is None
    assert got["relation", 9].ref_roles == ["outer", ""] and got["relation", 9].ref_types == ["way", "node"] and got["relation", 9].refs == [7, 10]
    with pytest.raises(ValueError):
        osm.inflate(field(4, b"lzma"))


def many(spark, n):
    sources.register(spark)
    return spark.range(0, n, 1, 3).selectExpr("CAST(id AS INT) AS id", "concat('n,]}\"', id) AS name", "id / 2D AS value", "IF(id % 50 = 7, NULL, st_point(id, -id)) AS geom")


@pytest.mark.parametrize("name", ["m.shp", "m.geojson"])
def test_one_file_is_not_held_whole(spark, tmp_path, name, monkeypatch):
    """Neither the driver nor a task takes the rows or the content of a whole file; pieces and ranges get their places."""
    monkeypatch.setattr(dispatch, "RECORDS", 32, raising=False)
    monkeypatch.setattr(dispatch, "STEP", 5000, raising=False)
    monkeypatch.setattr(dispatch, "PART", 10_000, raising=False)
    path, df = str(tmp_path / name), many(spark, 1000)
    frame, taken = type(df), []
    collect, take = frame.collect, frame.take
    monkeypatch.setattr(frame, "collect", lambda self: [taken.append(len(r)) or r for r in [collect(self)]][0])
    monkeypatch.setattr("tessera.sources.files.content", lambda spark, path: b"UTF-8" if path.endswith(".cpg") else pytest.fail(f"the driver reads {path}"))
    sources.st_write(df, path, dispatch.driver_of(path))
    back = sources.st_read(spark, path)
    parts = back.rdd.getNumPartitions()
    assert max([0, *taken]) < 100 and parts > 1
    monkeypatch.undo()
    want = sorted((i, f'n,]}}"{i}', i / 2, None if i % 50 == 7 else f"POINT ({i} {-i if i else 0})") for i in range(1000))
    assert sorted(tuple(r) for r in back.selectExpr("CAST(id AS INT)", "name", "CAST(value AS DOUBLE)", "st_astext(geom)").collect()) == want
    if name == "m.shp":
        shp, shx, dbf = (open(path[:-3] + x, "rb").read() for x in ("shp", "shx", "dbf"))
        assert [len(shp), len(shx)] == [2 * struct.unpack(">i", x[24:28])[0] for x in (shp, shx)]
        assert struct.unpack("<I", dbf[4:8])[0] == 1000 and struct.unpack("<4d", shp[36:68]) == (0, -999, 999, 0)
        at = 100
        for k in range(1000):  # each record has its number, and the index its place
            number, size = struct.unpack(">2i", shp[at : at + 8])
            assert number == k + 1 and struct.unpack(">2i", shx[100 + 8 * k : 108 + 8 * k]) == (at // 2, size)
            at += 8 + 2 * size
        assert at == len(shp)
        meta = dispatch.shapefile_meta(spark, path).first()
        assert meta["count"] == 1000 and meta.shape_type == "POINT"
        os.remove(path[:-3] + "shx")
        assert sorted(r.id for r in sources.st_read(spark, path).collect()) == list(range(1000))
    else:
        assert len(json.load(open(path))["features"]) == 1000


def test_shapefile_refuses(spark, tmp_path):
    for rows, message in (([(1, "a", 1.0, "POINT (1 2)"), (2, "b", 1.0, "LINESTRING (0 0, 1 1)")], "one kind"), ([(1, "x" * 300, 1.0, "POINT (1 2)")], "longer")):
        with pytest.raises(ValueError, match=message):
            sources.st_write(table(spark, rows), str(tmp_path / "r.shp"), "ESRI Shapefile")


@pytest.mark.parametrize("text", [
    '{"features": [{"type":"Feature","properties":{"k":1},"geometry":{"type":"Point","coordinates":[1,2]}}, \n {"type":"Feature","properties":{"k":2,"features":[1]},"geometry":null} ], "type": "FeatureCollection"}',
    '{"type":"FeatureCollection","features":[],"features":[{"properties":{"k":1},"geometry":{"type":"Point","coordinates":[1,2]}},{"properties":{"k":2},"geometry":null}]}',
    '﻿{"type":"FeatureCollection","a":{"features":[3]},"b":"\\"features\\":[","features":[{"properties":{"k":1,"s":"}],["},"geometry":{"type":"Point","coordinates":[1,2]}}\n,{"properties":{"k":2},"geometry":null}]}',
])
def test_geojson_documents(spark, tmp_path, text):
    sources.register(spark)
    path = tmp_path / "d.geojson"
    path.write_text(text)
    assert texts(sources.st_read(spark, str(path)), "k") == [(1, "POINT (1 2)"), (2, None)]
    path.write_text('{"type":"Feature","properties":{"k":5},"geometry":{"type":"Point","coordinates":[3,4]}}')
    assert texts(sources.st_read(spark, str(path)), "k") == [(5, "POINT (3 4)")]
    path.write_text('{"type":"FeatureCollection","features":[ ]}')
    assert sources.st_read(spark, str(path)).count() == 0
