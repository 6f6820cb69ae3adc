"""The registered queries of the geospatial engine, with SQL that gives the same rows.

The tables have no geometry, so coordinates are derived from keys by integer
arithmetic, with the same text in both engines; offsets of 1/8 keep points off edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions, operators, streaming
from .plans import layout
from .shared import settle, shared_path
from .sources import dispatch, st_drivers, st_list_proj_crs, st_read, st_read_meta, st_write

TABLES = "region nation customer supplier part orders lineitem events".split()

#: Derived fixtures, as common table expressions that both engines read.
PTS = "order_pt AS (SELECT o_orderkey, o_custkey, CAST((o_orderkey * 37) % 360 - 180 AS DOUBLE) AS x, CAST((o_orderkey * 53) % 170 - 85 AS DOUBLE) AS y FROM orders)"
CPT = "cust_pt AS (SELECT c_custkey, CAST((c_custkey * 29) % 360 - 180 AS DOUBLE) AS x, CAST((c_custkey * 31) % 170 - 85 AS DOUBLE) AS y FROM customer)"
BOX = "part_box AS (SELECT p_partkey, CAST((p_partkey * 7) % 100 AS DOUBLE) AS x0, CAST((p_partkey * 11) % 100 AS DOUBLE) AS y0, CAST((p_partkey * 7) % 100 + 1 + p_size % 10 AS DOUBLE) AS x1, CAST((p_partkey * 11) % 100 + 1 + p_size % 10 AS DOUBLE) AS y1 FROM part)"
SEG = "pts AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_suppkey % 100 AS DOUBLE) AS y FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber))"
LINES = f"{SEG}, lines AS (SELECT l_orderkey, transform(array_sort(collect_list(struct(l_linenumber AS n, named_struct('x', x, 'y', y) AS p))), s -> s.p) AS l FROM pts GROUP BY l_orderkey)"
NATION = "squares AS (SELECT n_nationkey AS k, 6.0 * n_nationkey + 0.125 AS lo, 6.0 * n_nationkey + 5.875 AS hi, n_nationkey % 2 AS hole FROM nation)"


def _ring(lo: str, hi: str) -> str:
    return "array(" + ", ".join(f"st_point2d(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in ((lo, lo), (lo, hi), (hi, hi), (hi, lo), (lo, lo))) + ")"


POLYS = f"{NATION}, polys AS (SELECT k, IF(hole = 1, array({_ring('lo', 'hi')}, {_ring('lo + 2.375', 'lo + 3.375')}), array({_ring('lo', 'hi')})) AS p FROM squares)"
BOXES = f"{BOX}, boxes AS (SELECT p_partkey, st_box2d(x0, y0, x1, y1) AS b, st_makeenvelope(x0, y0, x1, y1) AS g FROM part_box)"
POINTS = f"{PTS}, points AS (SELECT o_orderkey, o_custkey, st_point2d(x, y) AS p, st_point(x, y) AS g FROM order_pt)"


def _digits(tx: str, ty: str, level: int) -> str:
    return " || ".join(f"CAST((({tx} // {1 << i}) % 2) + 2 * (({ty} // {1 << i}) % 2) AS VARCHAR)" for i in range(level - 1, -1, -1))


def _quadkey(x: str, y: str, level: int) -> str:
    lat = f"greatest(-85.05112878, least(85.05112878, {y}))"
    s = f"sin({lat} * pi() / 180)"
    return _digits(f"CAST(floor(({x} + 180) / 360 * {1 << level}) AS BIGINT)", f"CAST(floor((0.5 - ln((1 + {s}) / (1 - {s})) / (4 * pi())) * {1 << level}) AS BIGINT)", level)


SEGMENTS = f"{SEG}, seg AS (SELECT l_orderkey, l_linenumber, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pts WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))"
_HIT = "a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0"
_NEAR = "sin((c.x - o.x) * pi() / 360)"

def _hilbert_sql() -> str:
    """The code on a curve of 16 levels, a subquery for each, of three points of each box."""
    cell = lambda v: f"CAST(floor(({v}) * (65535 / 128.0)) AS BIGINT)"
    at = f"SELECT p_partkey, 'h' AS n, {cell('(x0 + x1) / 2')} AS x, {cell('(y0 + y1) / 2')} AS y, CAST(0 AS BIGINT) AS d FROM part_box UNION ALL SELECT p_partkey, 'c', {cell('x0')}, {cell('y1')}, CAST(0 AS BIGINT) FROM part_box"
    for i in range(15, -1, -1):
        rx, ry = f"((x >> {i}) & 1)", f"((y >> {i}) & 1)"
        turned = lambda own, other: f"CASE WHEN {ry} = 1 THEN {own} WHEN {rx} = 1 THEN 65535 - {other} ELSE {other} END"  # noqa: B023, E731
        at = f"SELECT p_partkey, n, {turned('x', 'y')} AS x, {turned('y', 'x')} AS y, d + {1 << 2 * i} * xor(3 * {rx}, {ry}) AS d FROM ({at})"
    return f"WITH {BOX} SELECT p_partkey, max(d) FILTER (n = 'h') AS h, max(d) FILTER (n = 'h') AS gh, max(d) FILTER (n = 'c') AS c FROM ({at}) GROUP BY p_partkey"


#: name: (Spark SQL, SQL with the same rows)
SQL: dict[str, tuple[str, str]] = {
    "point2d_xy": (f"WITH {POINTS} SELECT o_orderkey, st_x_point2d(p) AS x, st_y_point2d(p) AS y, st_x(g) AS gx, st_y(g) AS gy FROM points", f"WITH {PTS} SELECT o_orderkey, x, y, x AS gx, y AS gy FROM order_pt"),
    "box_measures": (
        f"WITH {BOXES} SELECT p_partkey, st_area_box2d(b) AS area, st_perimeter_box2d(b) AS perimeter, st_npoints_box2d(b) AS n, st_centroid_box2d(b).x AS cx, st_centroid_box2d(b).y AS cy, st_area(g) AS garea, st_perimeter(g) AS gperimeter, st_xmin_box2d(b) AS x0, st_ymax_box2d(b) AS y1 FROM boxes",
        f"WITH {BOX} SELECT p_partkey, (x1 - x0) * (y1 - y0) AS area, 2 * ((x1 - x0) + (y1 - y0)) AS perimeter, CAST(4 AS BIGINT) AS n, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (x1 - x0) * (y1 - y0) AS garea, 2 * ((x1 - x0) + (y1 - y0)) AS gperimeter, x0, y1 FROM part_box",
    ),
    "line_measures": (
        f"WITH {LINES} SELECT l_orderkey, st_npoints_linestring2d(l) AS n, st_startpoint_linestring2d(l).x AS sx, st_endpoint_linestring2d(l).y AS ey, st_pointn_linestring2d(l, 2).x AS x2, round(st_length_linestring2d(l), 6) AS length, st_xmin_linestring2d(l) AS xmin, st_ymax_linestring2d(l) AS ymax FROM lines",
        f"WITH {SEGMENTS} SELECT l_orderkey, count(*) AS n, arg_min(x, l_linenumber) AS sx, arg_max(y, l_linenumber) AS ey, list(x ORDER BY l_linenumber)[2] AS x2, round(coalesce(sum(sqrt((x - px) ** 2 + (y - py) ** 2)), 0), 6) AS length, min(x) AS xmin, max(y) AS ymax FROM seg GROUP BY l_orderkey",
    ),
    "line_centroid": (
        f"WITH {LINES} SELECT l_orderkey, round(st_centroid_linestring2d(l).x, 6) AS cx, round(st_centroid_linestring2d(l).y, 6) AS cy FROM lines",
        f"WITH {SEGMENTS}, s AS (SELECT *, sqrt((x - px) ** 2 + (y - py) ** 2) AS d FROM seg) SELECT l_orderkey, round(CASE WHEN coalesce(sum(d), 0) = 0 THEN arg_min(x, l_linenumber) ELSE sum(d * (x + px) / 2) / sum(d) END, 6) AS cx, round(CASE WHEN coalesce(sum(d), 0) = 0 THEN arg_min(y, l_linenumber) ELSE sum(d * (y + py) / 2) / sum(d) END, 6) AS cy FROM s GROUP BY l_orderkey",
    ),
    "line_geometry_measures": (
        f"WITH {LINES}, gl AS (SELECT l_orderkey, l, st_geometry_linestring2d(l) AS g FROM lines WHERE size(l) > 1) SELECT l_orderkey, CAST(st_npoints(g) AS BIGINT) AS n, round(st_length(g), 6) AS length, st_geometrytype(g) AS kind, st_dimension(g) AS dim, st_ymin(g) AS ymin, st_npoints(st_points(g)) AS n_points, st_x(st_startpoint(g)) AS sx, st_y(st_endpoint(g)) AS ey FROM gl",
        f"WITH {SEGMENTS} SELECT l_orderkey, count(*) AS n, round(sum(sqrt((x - px) ** 2 + (y - py) ** 2)), 6) AS length, 'LINESTRING' AS kind, 1 AS dim, min(y) AS ymin, count(*) AS n_points, arg_min(x, l_linenumber) AS sx, arg_max(y, l_linenumber) AS ey FROM seg GROUP BY l_orderkey HAVING count(*) > 1",
    ),
    "poly_measures": (
        f"WITH {POLYS} SELECT k, st_area_polygon2d(p) AS area, st_perimeter_polygon2d(p) AS perimeter, st_ninteriorrings_polygon2d(p) AS holes, st_npoints_polygon2d(p) AS n, st_npoints_linestring2d(st_exteriorring_polygon2d(p)) AS shell, round(st_centroid_polygon2d(p).x, 6) AS cx, st_xmax_polygon2d(p) AS xmax FROM polys",
        f"WITH {NATION} SELECT k, CAST(5.75 * 5.75 - hole AS DOUBLE) AS area, CAST(23 + 4 * hole AS DOUBLE) AS perimeter, hole AS holes, CAST(5 + 5 * hole AS BIGINT) AS n, CAST(5 AS BIGINT) AS shell, round(CAST((lo + hi) / 2 AS DOUBLE), 6) AS cx, CAST(hi AS DOUBLE) AS xmax FROM squares",
    ),
    "poly_geometry_measures": (
        f"WITH {POLYS}, gp AS (SELECT k, st_geometry_polygon2d(p) AS g FROM polys) SELECT k, st_area(g) AS area, st_perimeter(g) AS perimeter, st_ninteriorrings(g) AS holes, st_isvalid(g) AS valid, st_area(st_convexhull(g)) AS hull, st_area(st_envelope(g)) AS env, st_npoints(st_exteriorring(g)) AS shell, st_length(st_boundary(g)) AS bound, st_contains(g, st_pointonsurface(g)) AS inside, st_area(st_polygon2d_shell(g)) AS back FROM gp".replace("st_area(st_polygon2d_shell(g))", "st_area_polygon2d(st_polygon2d_from_geometry(g))"),
        f"WITH {NATION} SELECT k, CAST(5.75 * 5.75 - hole AS DOUBLE) AS area, CAST(23 + 4 * hole AS DOUBLE) AS perimeter, hole AS holes, true AS valid, CAST(5.75 * 5.75 AS DOUBLE) AS hull, CAST(5.75 * 5.75 AS DOUBLE) AS env, CAST(5 AS BIGINT) AS shell, CAST(23 + 4 * hole AS DOUBLE) AS bound, true AS inside, CAST(5.75 * 5.75 - hole AS DOUBLE) AS back FROM squares",
    ),
    "point_point_distance": (f"WITH {POINTS}, {CPT} SELECT o_orderkey, round(st_distance_point2d(p, st_point2d(x, y)), 6) AS d, round(st_distance(g, st_point(x, y)), 6) AS gd FROM points JOIN cust_pt ON o_custkey = c_custkey", f"WITH {PTS}, {CPT} SELECT o_orderkey, round(sqrt((o.x - c.x) ** 2 + (o.y - c.y) ** 2), 6) AS d, round(sqrt((o.x - c.x) ** 2 + (o.y - c.y) ** 2), 6) AS gd FROM order_pt o JOIN cust_pt c ON o_custkey = c_custkey"),
    "point_line_distance": (
        f"WITH {POINTS} SELECT o_orderkey, round(st_distance_point2d_linestring2d(p, array(st_point2d(-50D, -20D), st_point2d(50D, -20D), st_point2d(50D, 40D))), 6) AS d FROM points",
        f"WITH {PTS} SELECT o_orderkey, round(least(sqrt((x - greatest(-50, least(50, x))) ** 2 + (y + 20) ** 2), sqrt((x - 50) ** 2 + (y - greatest(-20, least(40, y))) ** 2)), 6) AS d FROM order_pt",
    ),
    "distance_sphere": (
        f"WITH {PTS}, {CPT} SELECT o_orderkey, round(st_distance_sphere_point2d(st_point2d(o.y, o.x), st_point2d(c.y, c.x)), 3) AS d, round(st_distance_sphere(st_point(o.y, o.x), st_point(c.y, c.x)), 3) AS gd FROM order_pt o JOIN cust_pt c ON o_custkey = c_custkey",
        f"WITH {PTS}, {CPT} SELECT o_orderkey, round(d, 3) AS d, round(d, 3) AS gd FROM (SELECT o_orderkey, 2 * 6371000 * asin(least(1, sqrt(sin((c.y - o.y) * pi() / 360) ** 2 + cos(o.y * pi() / 180) * cos(c.y * pi() / 180) * {_NEAR} ** 2))) AS d FROM order_pt o JOIN cust_pt c ON o_custkey = c_custkey)",
    ),
    "quadkey": (f"WITH {POINTS} SELECT o_orderkey, st_quadkey(g, 8) AS q FROM points", f"WITH {PTS} SELECT o_orderkey, {_quadkey('(x)', '(y)', 8)} AS q FROM order_pt"),
    "flip_coordinates": (f"WITH {POINTS} SELECT o_orderkey, st_flipcoordinates_point2d(p).x AS fx, st_y(st_flipcoordinates(g)) AS fy FROM points", f"WITH {PTS} SELECT o_orderkey, y AS fx, x AS fy FROM order_pt"),
    "remove_repeated": (
        f"WITH {LINES}, d AS (SELECT l_orderkey, flatten(transform(l, v -> array(v, v))) AS l FROM lines) SELECT l_orderkey, st_npoints_linestring2d(st_removerepeatedpoints_linestring2d(l)) AS n, st_npoints(st_removerepeatedpoints(st_geometry_linestring2d(l))) AS gn FROM d WHERE size(l) > 2",
        f"WITH {SEGMENTS} SELECT l_orderkey, greatest(2, count(*) FILTER (px IS NULL OR px <> x OR py <> y)) AS n, greatest(2, count(*) FILTER (px IS NULL OR px <> x OR py <> y)) AS gn FROM seg GROUP BY l_orderkey HAVING count(*) > 1",
    ),
    "wkt_texts": (
        f"WITH {BOXES} SELECT p_partkey, st_astext(g) AS t, st_astext_box2d(b) AS bt, st_astext(st_centroid(g)) AS c FROM boxes",
        f"WITH {BOX}, n AS (SELECT p_partkey, CAST(CAST(x0 AS INT) AS VARCHAR) AS a, CAST(CAST(y0 AS INT) AS VARCHAR) AS b, CAST(CAST(x1 AS INT) AS VARCHAR) AS c, CAST(CAST(y1 AS INT) AS VARCHAR) AS d, x0 + x1 AS sx, y0 + y1 AS sy FROM part_box) SELECT p_partkey, 'POLYGON ((' || a || ' ' || b || ', ' || a || ' ' || d || ', ' || c || ' ' || d || ', ' || c || ' ' || b || ', ' || a || ' ' || b || '))' AS t, 'BOX(' || a || ' ' || b || ', ' || c || ' ' || d || ')' AS bt, 'POINT (' || CAST(CAST(sx AS INT) // 2 AS VARCHAR) || (CASE WHEN CAST(sx AS INT) % 2 = 1 THEN '.5' ELSE '' END) || ' ' || CAST(CAST(sy AS INT) // 2 AS VARCHAR) || (CASE WHEN CAST(sy AS INT) % 2 = 1 THEN '.5' ELSE '' END) || ')' AS c FROM n",
    ),
    "wkb_hex": (f"WITH {POINTS} SELECT o_orderkey, st_ashexwkb(g) AS h FROM points", f"WITH {PTS} SELECT o_orderkey, hex(ST_AsWKB(ST_GeomFromText('POINT(' || x || ' ' || y || ')'))) AS h FROM order_pt".replace("ST_GeomFromText(", "CAST(").replace("|| ')'))) AS h", "|| ')' AS GEOMETRY))) AS h")),
    "geojson_texts": (f"WITH {POINTS} SELECT o_orderkey, st_asgeojson(g) AS j, st_asgeojson(st_geomfromgeojson(st_asgeojson(g))) AS back FROM points", f"WITH {PTS}, j AS (SELECT o_orderkey, '{{\"type\":\"Point\",\"coordinates\":[' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ']}}' AS j FROM order_pt) SELECT o_orderkey, j, j AS back FROM j"),
    "wkb_round_trip": (f"WITH {BOXES} SELECT p_partkey, st_aswkb(st_geomfromhexwkb(st_ashexwkb(st_geomfromtext(st_astext(g))))) = g AS same, st_zmflag(st_force4d(g, 1D, 2D)) AS zm, st_hasz(st_force3dz(g)) AS z, st_hasm(st_force3dm(g)) AS m, st_zmflag(st_force2d(st_force4d(g))) AS flat FROM boxes", f"WITH {BOX} SELECT p_partkey, true AS same, 3 AS zm, true AS z, true AS m, 0 AS flat FROM part_box"),
    "collect_dump": (
        f"WITH {BOXES}, c AS (SELECT p_partkey, st_collect(array(g, st_flipcoordinates(g), NULL)) AS g FROM boxes) SELECT p_partkey, st_geometrytype(g) AS kind, st_ngeometries(g) AS n, st_npoints(g) AS np, d.path[0] AS part, st_area(d.geom) AS area FROM c LATERAL VIEW explode(st_dump(g)) t AS d",
        f"WITH {BOX} SELECT p_partkey, 'MULTIPOLYGON' AS kind, 2 AS n, CAST(10 AS BIGINT) AS np, part, (x1 - x0) * (y1 - y0) AS area FROM part_box, (SELECT unnest([1, 2]) AS part)",
    ),
    "collection_extract": (f"WITH {BOXES}, c AS (SELECT p_partkey, st_collect(array(g, st_centroid(g), st_exteriorring(g))) AS g FROM boxes) SELECT p_partkey, st_geometrytype(g) AS kind, st_geometrytype(st_collectionextract(g)) AS k0, st_ngeometries(st_collectionextract_type(g, 1)) AS n1, st_length(st_collectionextract_type(g, 2)) AS l2, st_geometrytype(st_multi(st_centroid(g))) AS m FROM c", f"WITH {BOX} SELECT p_partkey, 'GEOMETRYCOLLECTION' AS kind, 'MULTIPOLYGON' AS k0, 1 AS n1, 2 * ((x1 - x0) + (y1 - y0)) AS l2, 'MULTIPOINT' AS m FROM part_box"),
    "buffer_area": (f"WITH {POINTS} SELECT o_orderkey, round(st_area(st_buffer(g, 2D)), 6) AS a, st_npoints(st_buffer(g, 1D, 4)) AS n, st_area(st_buffer(st_makeline(g, st_point(st_x(g) + 4, st_y(g))), 1D, 8, 'CAP_FLAT')) AS flat FROM points", f"WITH {PTS} SELECT o_orderkey, round(64 * sin(2 * pi() / 32), 6) AS a, CAST(17 AS BIGINT) AS n, CAST(8 AS DOUBLE) AS flat FROM order_pt"),
    "simplify_reverse": (
        f"WITH {BOXES} SELECT p_partkey, st_npoints(st_simplify(st_makeline_list(array(st_point(b.min_x, b.min_y), st_point(b.min_x + 1, b.min_y), st_point(b.min_x + 2, b.min_y))), 0.5D)) AS n, st_npoints(st_simplifypreservetopology(g, 0.25D)) AS np, st_x(st_startpoint(st_reverse(st_makeline(st_point(b.min_x, b.min_y), st_point(b.max_x, b.max_y))))) AS rx, st_equals(st_normalize(g), g) AS same, st_isvalid(st_makevalid(g)) AS ok, st_x(st_reduceprecision(st_point(b.min_x + 0.26D, b.min_y), 0.1D)) AS px FROM boxes",
        f"WITH {BOX} SELECT p_partkey, CAST(2 AS BIGINT) AS n, CAST(5 AS BIGINT) AS np, x1 AS rx, true AS same, true AS ok, round(x0 + 0.3, 1) AS px FROM part_box",
    ),
    "line_merge": (f"WITH {BOXES} SELECT p_partkey, st_geometrytype(st_linemerge(st_collect(array(st_makeline(st_point(b.min_x, b.min_y), st_point(b.max_x, b.min_y)), st_makeline(st_point(b.max_x, b.min_y), st_point(b.max_x, b.max_y)))))) AS k, st_length(st_linemerge(st_collect(array(st_makeline(st_point(b.min_x, b.min_y), st_point(b.max_x, b.min_y)), st_makeline(st_point(b.max_x, b.min_y), st_point(b.max_x, b.max_y)))), true)) AS l, st_length(st_shortestline(g, st_point(b.max_x + 3, b.max_y))) AS s, st_dwithin(g, st_point(b.max_x + 3, b.max_y), 3D) AS near, st_isclosed(st_exteriorring(g)) AS cl, st_isring(st_exteriorring(g)) AS r, st_issimple(g) AS si FROM boxes", f"WITH {BOX} SELECT p_partkey, 'LINESTRING' AS k, (x1 - x0) + (y1 - y0) AS l, CAST(3 AS DOUBLE) AS s, true AS near, true AS cl, true AS r, true AS si FROM part_box"),
    "extent_agg": (f"WITH {POINTS} SELECT o_custkey % 20 AS grp, min(st_extent(g).min_x) AS min_x, max(st_extent(g).max_y) AS max_y, st_area(st_extent_agg(g)) AS area FROM points GROUP BY o_custkey % 20", f"WITH {PTS} SELECT o_custkey % 20 AS grp, min(x) AS min_x, max(y) AS max_y, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM order_pt GROUP BY o_custkey % 20"),
    "transform_3857": (f"WITH {PTS} SELECT o_orderkey, round(st_x(st_transform(st_point(y, x), 'EPSG:4326', 'EPSG:3857')), 3) AS e, round(st_transform_point2d(st_point2d(x, y), 'EPSG:4326', 'EPSG:3857', true).y, 3) AS n FROM order_pt", f"WITH {PTS} SELECT o_orderkey, round(6378137 * x * pi() / 180, 3) AS e, round(6378137 * ln(tan(pi() / 4 + y * pi() / 360)), 3) AS n FROM order_pt"),
    "transform_utm_round_trip": (f"WITH {PTS}, t AS (SELECT o_orderkey, st_transform(st_point(x / 60 + 15, y / 2), 'OGC:CRS84', 'EPSG:32633') AS g, x, y FROM order_pt) SELECT o_orderkey, round(st_x(st_transform(g, 'EPSG:32633', 'OGC:CRS84')), 6) AS x, round(st_y(st_transform(g, 'EPSG:32633', 'OGC:CRS84')), 6) AS y FROM t", f"WITH {PTS} SELECT o_orderkey, round(x / 60 + 15, 6) AS x, round(y / 2, 6) AS y FROM order_pt"),
    "window_rank_by_distance": (f"WITH {POINTS} SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY st_distance_point2d(p, st_point2d(0D, 0D)), o_orderkey) AS BIGINT) AS r FROM points", f"WITH {PTS} SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sqrt(x * x + y * y), o_orderkey) AS r FROM order_pt"),
    "knn_topk": (f"WITH {POINTS} SELECT o_orderkey, st_distance_point2d(p, st_point2d(10D, 10D)) AS d FROM points ORDER BY d, o_orderkey LIMIT 25", f"WITH {PTS} SELECT o_orderkey, sqrt((x - 10) * (x - 10) + (y - 10) * (y - 10)) AS d FROM order_pt ORDER BY d, o_orderkey LIMIT 25"),
    "group_rollup": (f"WITH {BOXES} SELECT p_partkey % 3 AS a, p_partkey % 2 AS b, count(*) AS n, sum(st_area_box2d(boxes.b)) AS area FROM boxes GROUP BY ROLLUP (p_partkey % 3, p_partkey % 2)", f"WITH {BOX} SELECT p_partkey % 3 AS a, p_partkey % 2 AS b, count(*) AS n, sum((x1 - x0) * (y1 - y0)) AS area FROM part_box GROUP BY ROLLUP (p_partkey % 3, p_partkey % 2)"),
    "spheroid_measures": (f"WITH {PTS} SELECT o_orderkey, st_distance_spheroid(st_point(y, x), st_point(y / 2, x / 2)) AS d, st_area_spheroid(st_makeenvelope(y / 2, x / 2, y / 2 + 1, x / 2 + 1)) AS a, st_perimeter_spheroid(st_makeenvelope(y / 2, x / 2, y / 2 + 1, x / 2 + 1)) AS p, st_dwithin_spheroid(st_point(y, x), st_point(y / 2, x / 2), 1e6) AS w FROM order_pt", ""),
    "hilbert": (f"WITH {BOXES} SELECT p_partkey, st_hilbert_box2d(b, st_box2d(0D, 0D, 128D, 128D)) AS h, st_hilbert(g, st_box2d(0D, 0D, 128D, 128D)) AS gh, st_hilbert_xy(b.min_x, b.max_y, st_box2d(0D, 0D, 128D, 128D)) AS c FROM boxes", _hilbert_sql()),
    "hilbert_world": (f"WITH {BOXES} SELECT p_partkey, st_hilbert_world(g) AS w FROM boxes", ""),
    "svg": (f"WITH {BOXES} SELECT p_partkey, st_assvg(g) AS s FROM boxes", f"WITH {BOX}, n AS (SELECT p_partkey, CAST(CAST(x0 AS INT) AS VARCHAR) AS a, CASE WHEN y0 = 0 THEN '0' ELSE '-' || CAST(CAST(y0 AS INT) AS VARCHAR) END AS b, CAST(CAST(x1 AS INT) AS VARCHAR) AS c, '-' || CAST(CAST(y1 AS INT) AS VARCHAR) AS d FROM part_box) SELECT p_partkey, 'M ' || a || ' ' || b || ' L ' || a || ' ' || d || ' ' || c || ' ' || d || ' ' || c || ' ' || b || ' Z' AS s FROM n"),
    "tile_counts_in_polygon": (
        f"WITH {POINTS} SELECT st_quadkey(g, 5) AS tile, count(*) AS n, min(p.x) AS min_x, max(p.y) AS max_y FROM points WHERE st_within_point2d(p, array(array(st_point2d(-120.125D, 0.125D), st_point2d(0.125D, 60.125D), st_point2d(120.125D, 0.125D), st_point2d(0.125D, -60.125D), st_point2d(-120.125D, 0.125D)))) GROUP BY st_quadkey(g, 5)",
        f"WITH {PTS} SELECT {_quadkey('(x)', '(y)', 5)} AS tile, count(*) AS n, min(x) AS min_x, max(y) AS max_y FROM order_pt WHERE CASE WHEN x < 0.125 THEN abs(y - 0.125) < (x + 120.125) * 60 / 120.25 ELSE abs(y - 0.125) < (120.125 - x) * 60 / 120 END AND CASE WHEN y > 0.125 THEN true ELSE CASE WHEN x < 0.125 THEN 0.125 - y < (x + 120.125) * 60.25 / 120.25 ELSE 0.125 - y < (120.125 - x) * 60.25 / 120 END END GROUP BY 1",
    ),
}
# the lower half of the polygon is 60.25 high, the upper 60: the oracle states both edges
SQL["tile_counts_in_polygon"] = (
    SQL["tile_counts_in_polygon"][0],
    f"WITH {PTS} SELECT {_quadkey('(x)', '(y)', 5)} AS tile, count(*) AS n, min(x) AS min_x, max(y) AS max_y FROM order_pt WHERE abs(y - 0.125) < (CASE WHEN x < 0.125 THEN (x + 120.125) / 120.25 ELSE (120.125 - x) / 120 END) * (CASE WHEN y > 0.125 THEN 60 ELSE 60.25 END) GROUP BY 1",
)


#: Points with Z and M, segments that cross or not, quadrilaterals that are simple or not, all by the keys.
Z4 = "z4 AS (SELECT o_orderkey AS k, x, y, CAST(o_custkey % 50 AS DOUBLE) AS z, CAST(o_orderkey % 9 AS DOUBLE) AS m FROM order_pt)"
CROSS = "cross_at AS (SELECT o_orderkey AS k, CAST(o_orderkey % 13 - 1 AS DOUBLE) AS v, CAST(o_custkey % 7 AS DOUBLE) AS a, CAST(o_custkey % 7 + 1 + o_orderkey % 5 AS DOUBLE) AS b FROM orders)"
QUAD = "quad AS (SELECT o_orderkey AS k, CAST(2 * (o_orderkey % 5) + 1 AS DOUBLE) AS u, CAST(2 * (o_custkey % 6) AS DOUBLE) AS w FROM orders)"
_RING = "array(st_point(0D, 0D), st_point(10D, 0D), st_point(u, 5D), st_point(w, 5D), st_point(0D, 0D))"
_DEG, _A, _N = "pi() / 180", 6378137.0, 0.00167922038638370431


def _meridian(lat: str) -> str:
    """Distance from the equator along a meridian of the WGS 84 spheroid, by its series."""
    n, t = _N, f"(({lat}) * {_DEG})"
    terms = [f"{1 + n**2 / 4 + n**4 / 64!r} * {t}", *[f"{c!r} * sin({i} * {t})" for i, c in ((2, -1.5 * (n - n**3 / 8)), (4, 15 / 16 * (n**2 - n**4 / 4)), (6, -35 / 48 * n**3), (8, 315 / 512 * n**4))]]
    return f"({_A / (1 + n)!r} * ({' + '.join(terms)}))"


SQL |= {
    "zm_accessors": (
        f"WITH {PTS}, {Z4}, g AS (SELECT *, st_force4d(st_point(x, y), z, m) AS p, st_makeline(st_force4d(st_point(x, y), z, m), st_force4d(st_point(x + 3, y - 2), z + 5, m - 2)) AS l FROM z4) SELECT k, st_z(p) AS pz, st_m(p) AS pm, st_zmin(l) AS zmin, st_zmax(l) AS zmax, st_mmin(l) AS mmin, st_mmax(l) AS mmax, st_xmin(l) AS xmin, st_xmax(l) AS xmax, st_ymin(l) AS ymin, st_ymax(l) AS ymax, st_numpoints(l) AS n FROM g",
        f"WITH {PTS}, {Z4} SELECT k, z AS pz, m AS pm, z AS zmin, z + 5 AS zmax, m - 2 AS mmin, m AS mmax, x AS xmin, x + 3 AS xmax, y - 2 AS ymin, y AS ymax, CAST(2 AS BIGINT) AS n FROM z4",
    ),
    "points_of_more_dimensions": (
        f"WITH {PTS}, {Z4}, p AS (SELECT *, st_point3d(x, y, z) AS p3, st_point4d(x, y, z, m) AS p4, st_point2d(x, y) AS p2 FROM z4) SELECT k, p3.z AS z3, p4.m AS m4, st_point3d_to_point2d(p3).x AS x3, st_point4d_to_point2d(p4).y AS y4, st_x(st_geometry_point2d(p2)) AS gx, st_point2d_from_geometry(st_point(x, y)).y AS py, st_xmin_point2d(p2) AS a, st_xmax_point2d(p2) AS b, st_ymin_point2d(p2) AS c, st_ymax_point2d(p2) AS d, st_npoints_point2d(p2) AS n, st_area_point2d(p2) AS area, st_centroid_point2d(p2).x AS cx, st_geometrytype_point2d(p2) AS kind, st_astext_point2d(p2) AS t FROM p",
        f"WITH {PTS}, {Z4} SELECT k, z AS z3, m AS m4, x AS x3, y AS y4, x AS gx, y AS py, x AS a, x AS b, y AS c, y AS d, CAST(1 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS area, x AS cx, 'POINT' AS kind, 'POINT (' || CAST(CAST(x AS INT) AS VARCHAR) || ' ' || CAST(CAST(y AS INT) AS VARCHAR) || ')' AS t FROM z4",
    ),
    "wkb_in": (
        f"WITH {BOXES}, w AS (SELECT p_partkey, b, g, st_aswkb(st_point(b.min_x, b.max_y)) AS p, st_aswkb(st_makeline(st_point(b.min_x, b.min_y), st_point(b.max_x, b.max_y))) AS l, st_aswkb(st_makepolygon(st_exteriorring(g))) AS r FROM boxes) SELECT p_partkey, st_x(st_geomfromwkb(p)) AS px, st_point2dfromwkb(p).y AS py, st_linestring2dfromwkb(l)[1].x AS lx, st_linestring2d_from_geometry(l)[0].y AS ly, st_area_polygon2d(st_polygon2dfromwkb(r)) AS area, st_xmin_polygon2d(st_polygon2dfromwkb(r)) AS xmin, st_ymax_polygon2d(st_polygon2dfromwkb(r)) AS ymax, st_y(st_geomfromhexewkb(st_ashexwkb(p))) AS hy, st_extent_wkb(r).max_x AS ex, st_area(st_makepolygon(st_exteriorring(g))) AS made FROM w",
        f"WITH {BOX} SELECT p_partkey, x0 AS px, y1 AS py, x1 AS lx, y0 AS ly, (x1 - x0) * (y1 - y0) AS area, x0 AS xmin, y1 AS ymax, y1 AS hy, x1 AS ex, (x1 - x0) * (y1 - y0) AS made FROM part_box",
    ),
    "approximate_boxes": (
        f"WITH {BOXES}, a AS (SELECT p_partkey, st_extent_approx(g) AS f FROM boxes) SELECT p_partkey, CAST(st_xmin_box2df(f) AS DOUBLE) AS x0, CAST(st_xmax_box2df(f) AS DOUBLE) AS x1, CAST(st_ymin_box2df(f) AS DOUBLE) AS y0, CAST(st_ymax_box2df(f) AS DOUBLE) AS y1, st_centroid_box2df(f).x AS cx, st_area(st_geometry_box2df(f)) AS area FROM a",
        f"WITH {BOX} SELECT p_partkey, x0, x1, y0, y1, (x0 + x1) / 2 AS cx, (x1 - x0) * (y1 - y0) AS area FROM part_box",
    ),
    "columnar_overloads": (
        f"WITH {BOXES}, c AS (SELECT p_partkey, b, array(st_point2d(b.min_x, b.min_y), st_point2d(b.max_x, b.max_y)) AS l, st_polygon2d_from_geometry(g) AS p FROM boxes) SELECT p_partkey, st_geometrytype_linestring2d(l) AS lk, st_geometrytype_polygon2d(p) AS pk, st_isempty_linestring2d(l) AS le, st_isempty_polygon2d(slice(p, 1, CAST(p_partkey % 2 AS INT))) AS pe, st_area_linestring2d(l) AS la, st_astext_linestring2d(l) AS lt, st_flipcoordinates_linestring2d(l)[1].x AS fl, st_flipcoordinates_polygon2d(p)[0][0].x AS fp, st_flipcoordinates_box2d(b).max_x AS fb, st_extent_linestring2d(l).max_y AS ey, st_xmax_linestring2d(l) AS lx, st_ymin_linestring2d(l) AS ly, st_xmax_polygon2d(p) AS px, st_ymin_polygon2d(p) AS py, st_distance_linestring2d_point2d(l, st_point2d(b.min_x - 3, b.min_y - 4)) AS d, st_area(st_geometry_box2d(b)) AS ba, st_isvalid_linestring2d(l) AS lv, st_npoints_polygon2d(p) AS n, st_xmax_box2d(b) AS bx, st_ymin_box2d(b) AS bmin FROM c",
        f"WITH {BOX}, t AS (SELECT *, CAST(CAST(x0 AS INT) AS VARCHAR) || ' ' || CAST(CAST(y0 AS INT) AS VARCHAR) || ', ' || CAST(CAST(x1 AS INT) AS VARCHAR) || ' ' || CAST(CAST(y1 AS INT) AS VARCHAR) AS ends FROM part_box) SELECT p_partkey, 'LINESTRING' AS lk, 'POLYGON' AS pk, false AS le, p_partkey % 2 = 0 AS pe, CAST(0 AS DOUBLE) AS la, 'LINESTRING (' || ends || ')' AS lt, y1 AS fl, y0 AS fp, y1 AS fb, y1 AS ey, x1 AS lx, y0 AS ly, x1 AS px, y0 AS py, CAST(5 AS DOUBLE) AS d, (x1 - x0) * (y1 - y0) AS ba, true AS lv, CAST(5 AS BIGINT) AS n, x1 AS bx, y0 AS bmin FROM t",
    ),
    "points_and_parts": (
        f"WITH {LINES}, gl AS (SELECT l_orderkey, st_geometry_linestring2d(l) AS g FROM lines WHERE size(l) > 1) SELECT l_orderkey, st_x(st_pointn(g, CAST(1 + l_orderkey % 2 AS INT))) AS x, st_y(st_pointn(g, -1)) AS y, st_numpoints(g) AS n, st_numgeometries(st_collect(array(g, st_reverse(g), st_startpoint(g)))) AS parts, coalesce(st_numinteriorrings(st_buffer(st_startpoint(g), 1D)), -1) AS holes FROM gl",
        f"WITH {SEGMENTS} SELECT l_orderkey, list(x ORDER BY l_linenumber)[CAST(1 + l_orderkey % 2 AS INT)] AS x, arg_max(y, l_linenumber) AS y, count(*) AS n, 3 AS parts, 0 AS holes FROM seg GROUP BY l_orderkey HAVING count(*) > 1",
    ),
    "line_predicates": (
        f"WITH {CROSS}, l AS (SELECT k, st_makeline(st_point(0D, 5D), st_point(10D, 5D)) AS f, st_makeline(st_point(v, a), st_point(v, b)) AS g FROM cross_at) SELECT k, st_crosses(f, g) AS c, st_intersects(f, g) AS i, st_disjoint(g, f) AS d, st_touches(g, f) AS t, st_dwithin(f, g, 1D) AS w, st_distance(f, g) AS far, st_length(st_shortestline(f, g)) AS s FROM l",
        f"WITH {CROSS}, h AS (SELECT *, v >= 0 AND v <= 10 AND a <= 5 AND b >= 5 AS i, v > 0 AND v < 10 AND a < 5 AND b > 5 AS c, sqrt(greatest(0, -v, v - 10) ** 2 + greatest(0, a - 5, 5 - b) ** 2) AS far FROM cross_at) SELECT k, c, i, NOT i AS d, i AND NOT c AS t, far <= 1 AS w, far, far AS s FROM h",
    ),
    "ring_validity": (
        f"WITH {QUAD}, r AS (SELECT k, u, w, st_makeline_list({_RING}) AS l, st_makeline_list(slice({_RING}, 1, 4 + CAST(k % 2 AS INT))) AS part FROM quad) SELECT k, st_issimple(l) AS s, st_isring(l) AS r, st_isvalid(st_makepolygon(l)) AS v, st_isclosed(part) AS c, st_isring(part) AS pr, st_isvalid(st_makevalid(st_makepolygon(l))) AS fixed, st_isvalid_polygon2d(array(array(st_point2d(0D, 0D), st_point2d(10D, 0D), st_point2d(u, 5D), st_point2d(w, 5D), st_point2d(0D, 0D)))) AS cv FROM r",
        f"WITH {QUAD} SELECT k, u > w AS s, u > w AS r, u > w AS v, k % 2 = 1 AS c, u > w AND k % 2 = 1 AS pr, true AS fixed, u > w AS cv FROM quad",
    ),
    "spheroid_lines": (
        f"WITH {PTS} SELECT o_orderkey, round(st_distance_spheroid(st_point(0D, x / 4), st_point(0D, y / 4)), 3) AS equator, round(st_distance_spheroid_point2d(st_point2d(x / 4, 7D), st_point2d(y / 2, 7D)), 3) AS meridian, round(st_length_spheroid(st_makeline_list(array(st_point(0D, x / 4), st_point(0D, y / 4), st_point(y / 2, y / 4)))), 3) AS both_ways, round(st_length_spheroid_linestring2d(array(st_point2d(x / 4, 3D), st_point2d(y / 2, 3D))), 3) AS columnar, st_dwithin_spheroid(st_point(0D, x / 4), st_point(0D, y / 4), 2e6) AS near, st_dwithin_spheroid_point2d(st_point2d(0D, x / 4), st_point2d(0D, y / 4), 1e6) AS nearer FROM order_pt",
        f"WITH {PTS}, d AS (SELECT o_orderkey, {_A} * abs(x - y) / 4 * {_DEG} AS e, abs({_meridian('x / 4')} - {_meridian('y / 2')}) AS m, abs({_meridian('y / 2')}) AS up FROM order_pt) SELECT o_orderkey, round(e, 3) AS equator, round(m, 3) AS meridian, round(e + up, 3) AS both_ways, round(m, 3) AS columnar, e <= 2e6 AS near, e <= 1e6 AS nearer FROM d",
    ),
    "sql_aggregates": (
        f"WITH {PTS}, c AS (SELECT o_custkey % 7 AS grp, st_makeenvelope(x, y, x + 1, y + 1) AS g, st_makeenvelope(x - 400, y - 400, x + 400, y + 400) AS wide FROM order_pt) SELECT grp, st_area(st_union_agg(g)) AS u, st_area(st_intersection_agg(wide)) AS i, st_xmin(st_extent_agg(g)) AS x0, st_ymax(st_envelope_agg(g)) AS y1 FROM c GROUP BY grp",
        f"WITH {PTS} SELECT o_custkey % 7 AS grp, CAST(count(DISTINCT (x, y)) AS DOUBLE) AS u, CAST((800 - (max(x) - min(x))) * (800 - (max(y) - min(y))) AS DOUBLE) AS i, min(x) AS x0, max(y) + 1 AS y1 FROM order_pt GROUP BY o_custkey % 7",
    ),
    "transform_boxes": (
        f"WITH {BOXES} SELECT p_partkey, round(st_transform_box2d(b, 'EPSG:4326', 'EPSG:3857', true).min_x, 3) AS x0, round(st_transform_box2d(st_box2d(b.min_x, b.min_y / 2, b.max_x, b.max_y / 2), 'EPSG:4326', 'EPSG:3857', true).max_y, 3) AS y1 FROM boxes",
        f"WITH {BOX} SELECT p_partkey, round(6378137 * x0 * pi() / 180, 3) AS x0, round(6378137 * ln(tan(pi() / 4 + y1 * pi() / 720)), 3) AS y1 FROM part_box",
    ),
}


def _views(spark: SparkSession, sf_dir: str) -> SparkSession:
    functions.register(spark)
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark


def _query(text: str):
    return lambda spark, sf_dir: _views(spark, sf_dir).sql(text)


def frame(spark: SparkSession, sf_dir: str, ctes: str, select: str) -> DataFrame:
    return _views(spark, sf_dir).sql(f"WITH {ctes} {select}")


def _points(spark, d):
    return frame(spark, d, POINTS, "SELECT o_orderkey, p, g FROM points")


def _boxes(spark, d):
    return frame(spark, d, BOXES, "SELECT p_partkey, b, g AS bg FROM boxes")


def point_in_polygon(spark, d):
    polys = settle(frame(spark, d, POLYS, "SELECT k, p AS poly FROM polys"))  # written, so that the planner meets the long expression once
    met = operators.spatial_join(_points(spark, d).select("o_orderkey", "p"), polys, "p", "poly", F.call_function("st_contains_polygon2d", "poly", "p"))
    return met.groupBy("k").agg(F.count("*").alias("n"))


def bbox_range_join(spark, d):
    return operators.spatial_join(_points(spark, d).select("o_orderkey", "p"), _boxes(spark, d).select("p_partkey", "b"), "p", "b", "bounds").select("o_orderkey", "p_partkey")


def spatial_join_within(spark, d):
    return operators.spatial_join(_points(spark, d).select("o_orderkey", "g"), _boxes(spark, d).select("p_partkey", "bg"), "g", "bg", "within").select("o_orderkey", "p_partkey")


def box_self_join(spark, d):
    other = _boxes(spark, d).select(F.col("p_partkey").alias("q"), F.col("bg").alias("qg"))
    return operators.spatial_join(_boxes(spark, d).select("p_partkey", "bg"), other, "bg", "qg", "intersects").select("p_partkey", "q")


def _box_pairs(spark, d, measures):
    """All pairs of boxes whose bounds meet, with measures over the boxes b and ob; apart counts the boxes that the left one does not meet."""
    boxes = _boxes(spark, d).select("p_partkey", "b")
    other = boxes.select(F.col("p_partkey").alias("q"), F.col("b").alias("ob"))
    apart = operators.match_counts(boxes, other, "b", "ob", "bounds").crossJoin(F.broadcast(boxes.agg(F.count("*").alias("total"))))
    left = boxes.join(apart.select("b", (F.col("total") - F.col("n")).alias("apart")), "b")
    return operators.spatial_join(left, other, "b", "ob", "bounds", measures=measures).select("p_partkey", "q", "apart", *measures)


def predicates(spark, d):
    named = {"intersects": "i", "disjoint": "d", "contains": "c", "within": "w", "covers": "cv", "coveredby": "cb", "equals": "e", "touches": "t", "overlaps": "ov", "containsproperly": "cp", "crosses": "cr", "intersects_extent": "ie"}
    shapes = [F.call_function("st_geometry_box2d", c) for c in ("b", "ob")]
    return _box_pairs(spark, d, {c: F.call_function(f"st_{f}", *shapes) for f, c in named.items()} | {"ib": F.call_function("st_intersects_box2d", "b", "ob")})


def overlay_areas(spark, d):
    shapes = [F.call_function("st_geometry_box2d", c) for c in ("b", "ob")]
    return _box_pairs(spark, d, {c: F.call_function("st_area", F.call_function(f"st_{f}", *shapes)) for f, c in (("intersection", "i"), ("union", "u"), ("difference", "d"))})


def dwithin_join(spark, d):
    custs = frame(spark, d, CPT, "SELECT c_custkey, st_point(x, y) AS cg FROM cust_pt")
    return operators.spatial_join(_points(spark, d).select("o_orderkey", "g"), custs, "g", "cg", "dwithin", distance=3.0).select("o_orderkey", "c_custkey")


def join_kind(how):
    def run(spark, d):
        left, right = _points(spark, d).select("o_orderkey", "p"), _boxes(spark, d).select("p_partkey", "b")
        out = operators.spatial_join(left, right, "p", "b", "bounds", how=how)
        return out.select("o_orderkey", "p_partkey") if how == "left" else out.select("o_orderkey")

    return run


def knn_join(spark, d):
    custs = frame(spark, d, CPT, "SELECT c_custkey, st_point2d(x, y) AS c FROM cust_pt")
    return operators.knn_join(custs, _points(spark, d).select("o_orderkey", "p"), "c_custkey", "o_orderkey", "c", "p", 3, 4.0).select("c_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("r"))


def union_agg_area(spark, d):
    cells = frame(spark, d, PTS, "SELECT o_custkey % 7 AS grp, st_makeenvelope(x, y, x + 1, y + 1) AS g FROM order_pt")
    return operators.union_agg(cells, ["grp"], "g", "u").select("grp", F.round(F.call_function("st_area", "u"), 6).alias("area"))


def intersection_agg_area(spark, d):
    cells = frame(spark, d, BOX, "SELECT p_partkey % 50 AS grp, st_makeenvelope(x0 - 100, y0 - 100, x1 + 50, y1 + 50) AS g FROM part_box")
    return operators.intersection_agg(cells, ["grp"], "g", "u").select("grp", F.round(F.call_function("st_area", "u"), 6).alias("area"))


def makeline_agg(spark, d):
    ev = frame(spark, d, "e AS (SELECT user_id, event_id, st_point2d(CAST(user_id % 64 AS DOUBLE), CAST(event_id % 64 AS DOUBLE)) AS p FROM events)", "SELECT * FROM e")
    lines = operators.makeline_agg(ev, ["user_id"], "p", "event_id", "l")
    return lines.select("user_id", F.call_function("st_npoints_linestring2d", "l").alias("n"), F.round(F.call_function("st_length_linestring2d", "l"), 6).alias("length"))


def layout_window(spark, d):
    """Writes the boxes in Hilbert order and reads a window of them."""
    path = shared_path(spark)
    layout.write_clustered(_boxes(spark, d), "b", path, 8)
    return layout.window(spark.read.parquet(path), (20.0, 20.0, 40.0, 40.0)).select("p_partkey")


def _written(spark, d, driver: str, name: str) -> str:
    """The path of a file (or folder) of a driver with a point for each part."""
    path = shared_path(spark, name)
    st_write(frame(spark, d, BOX, "SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, st_point(x0, y1) AS geom FROM part_box JOIN part USING (p_partkey)"), path, driver)
    return path


def source(driver: str, name: str, **options):
    """Writes a point for each part and reads the file again, by its name."""

    def run(spark, d):
        got = st_read(spark, _written(spark, d, driver, name), **options)
        return got.select(F.col("id").cast("bigint").alias("id"), "name", F.round(F.col("price").cast("double"), 2).alias("price"), F.call_function("st_x", "geom").alias("x"), F.call_function("st_y", "geom").alias("y"))

    return run


def source_meta(spark, d):
    read = st_read_meta(spark, _written(spark, d, "GeoJSON", "parts.geojson"))
    one = F.col("layers")[0]
    return read.select("driver_short_name", one["feature_count"].alias("n"), one["geometry_fields"][0]["type"].alias("kind"), F.size(one["fields"]).cast("bigint").alias("fields"))


def shapefile_meta(spark, d):
    read = dispatch.shapefile_meta(spark, _written(spark, d, "ESRI Shapefile", "parts.shp"))
    return read.select("shape_type", F.col("bounds.min_x").alias("x0"), F.col("bounds.max_y").alias("y1"), F.col("count").cast("bigint").alias("n"))


def streaming_tile_counts(spark, d):
    events = frame(spark, d, "e AS (SELECT ts, CAST(user_id % 64 AS DOUBLE) AS x, CAST(event_id % 64 AS DOUBLE) AS y FROM events)", "SELECT * FROM e")
    return streaming.tile_counts(events, "ts", "x", "y", 4).groupBy("tile").agg(F.sum("n").alias("n"), F.count("*").alias("windows"))


def generate_points(spark, d):
    functions.register(spark)
    p = operators.generate_points(spark, (0.0, 0.0, 10.0, 20.0), 10_000, 1337)
    inside = (p["point"]["x"] >= 0) & (p["point"]["x"] < 10) & (p["point"]["y"] >= 0) & (p["point"]["y"] < 20)
    return p.agg(F.count("*").alias("n"), F.sum(inside.cast("bigint")).alias("inside"))


_READ = f"WITH {BOX} SELECT p_partkey AS id, p_name AS name, round(p_retailprice, 2) AS price, x0 AS x, y1 AS y FROM part_box JOIN part USING (p_partkey)"
_IN = "o.x >= b.x0 AND o.x <= b.x1 AND o.y >= b.y0 AND o.y <= b.y1"
FRAMES: dict[str, tuple] = {
    "point_in_polygon": (point_in_polygon, f"WITH {PTS}, {NATION} SELECT k, count(*) AS n FROM order_pt o JOIN squares s ON o.x > lo AND o.x < hi AND o.y > lo AND o.y < hi AND NOT (hole = 1 AND o.x > lo + 2.375 AND o.x < lo + 3.375 AND o.y > lo + 2.375 AND o.y < lo + 3.375) GROUP BY k"),
    "bbox_range_join": (bbox_range_join, f"WITH {PTS}, {BOX} SELECT o_orderkey, p_partkey FROM order_pt o JOIN part_box b ON {_IN}"),
    "spatial_join_within": (spatial_join_within, f"WITH {PTS}, {BOX} SELECT o_orderkey, p_partkey FROM order_pt o JOIN part_box b ON o.x > b.x0 AND o.x < b.x1 AND o.y > b.y0 AND o.y < b.y1"),
    "box_self_join": (box_self_join, f"WITH {BOX} SELECT a.p_partkey, b.p_partkey AS q FROM part_box a JOIN part_box b ON {_HIT}"),
    "predicates": (predicates, f"WITH {BOX}, r AS (SELECT a.p_partkey, b.p_partkey AS q, (SELECT count(*) FROM part_box) - count(*) OVER (PARTITION BY a.p_partkey) AS apart, {_HIT} AS i, a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0 AS inner_hit, a.x0 <= b.x0 AND a.x1 >= b.x1 AND a.y0 <= b.y0 AND a.y1 >= b.y1 AS c, a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1 AS w, a.x0 < b.x0 AND a.x1 > b.x1 AND a.y0 < b.y0 AND a.y1 > b.y1 AS cp FROM part_box a JOIN part_box b ON {_HIT}) SELECT p_partkey, q, apart, i, NOT i AS d, c, w, c AS cv, w AS cb, c AND w AS e, i AND NOT inner_hit AS t, inner_hit AND NOT c AND NOT w AS ov, cp, false AS cr, i AS ie, i AS ib FROM r"),
    "overlay_areas": (overlay_areas, f"WITH {BOX}, r AS (SELECT a.p_partkey, b.p_partkey AS q, (SELECT count(*) FROM part_box) - count(*) OVER (PARTITION BY a.p_partkey) AS apart, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba FROM part_box a JOIN part_box b ON {_HIT}) SELECT p_partkey, q, apart, i, aa + ba - i AS u, aa - i AS d FROM r"),
    "dwithin_join": (dwithin_join, f"WITH {PTS}, {CPT} SELECT o_orderkey, c_custkey FROM order_pt o JOIN cust_pt c ON (o.x - c.x) ** 2 + (o.y - c.y) ** 2 <= 9"),
    "spatial_left_join": (join_kind("left"), f"WITH {PTS}, {BOX} SELECT o_orderkey, p_partkey FROM order_pt o LEFT JOIN part_box b ON {_IN}"),
    "spatial_semi_join": (join_kind("semi"), f"WITH {PTS}, {BOX} SELECT o_orderkey FROM order_pt o WHERE EXISTS (SELECT 1 FROM part_box b WHERE {_IN})"),
    "spatial_anti_join": (join_kind("anti"), f"WITH {PTS}, {BOX} SELECT o_orderkey FROM order_pt o WHERE NOT EXISTS (SELECT 1 FROM part_box b WHERE {_IN})"),
    "knn_join": (knn_join, f"WITH {PTS}, {CPT} SELECT c_custkey, o_orderkey, r FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt((o.x - c.x) * (o.x - c.x) + (o.y - c.y) * (o.y - c.y)), o_orderkey) AS r FROM order_pt o, cust_pt c) WHERE r <= 3"),
    "union_agg_area": (union_agg_area, f"WITH {PTS} SELECT o_custkey % 7 AS grp, CAST(count(DISTINCT (x, y)) AS DOUBLE) AS area FROM order_pt GROUP BY o_custkey % 7"),
    "intersection_agg_area": (intersection_agg_area, f"WITH {BOX} SELECT p_partkey % 50 AS grp, CAST(greatest(0, min(x1) + 50 - max(x0) + 100) * greatest(0, min(y1) + 50 - max(y0) + 100) AS DOUBLE) AS area FROM part_box GROUP BY p_partkey % 50"),
    "makeline_agg": (makeline_agg, "WITH e AS (SELECT user_id, event_id, CAST(user_id % 64 AS DOUBLE) AS x, CAST(event_id % 64 AS DOUBLE) AS y FROM events), s AS (SELECT *, lag(y) OVER (PARTITION BY user_id ORDER BY event_id) AS py FROM e) SELECT user_id, count(*) AS n, round(coalesce(sum(abs(y - py)), 0), 6) AS length FROM s GROUP BY user_id"),
    "layout_window": (layout_window, f"WITH {BOX} SELECT p_partkey FROM part_box WHERE x0 <= 40 AND x1 >= 20 AND y0 <= 40 AND y1 >= 20"),
    "streaming_tile_counts": (streaming_tile_counts, f"WITH e AS (SELECT time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '1970-01-01') AS w, {_quadkey('CAST(user_id % 64 AS DOUBLE)', 'CAST(event_id % 64 AS DOUBLE)', 4)} AS tile FROM events), c AS (SELECT w, tile, count(*) AS n FROM e GROUP BY w, tile) SELECT tile, CAST(sum(n) AS BIGINT) AS n, count(*) AS windows FROM c GROUP BY tile"),
    "generate_points": (generate_points, "SELECT CAST(10000 AS BIGINT) AS n, CAST(10000 AS BIGINT) AS inside"),
    **{f"source_{n}": (source(driver, name), _READ) for n, driver, name in (("geojson", "GeoJSON", "p.geojson"), ("geojsonseq", "GeoJSONSeq", "p.geojsonl"), ("shapefile", "ESRI Shapefile", "p.shp"), ("csv", "CSV", "p.csv"), ("parquet", "Parquet", "p.parquet"))},
    "source_window": (source("GeoJSONSeq", "w.geojsonl", bbox=(20.0, 20.0, 60.0, 40.0)), _READ + " WHERE x0 >= 20 AND x0 <= 60 AND y1 >= 20 AND y1 <= 40"),
    "source_meta": (source_meta, "SELECT 'GeoJSON' AS driver_short_name, count(*) AS n, 'POINT' AS kind, CAST(3 AS BIGINT) AS fields FROM part"),
    "shapefile_meta": (shapefile_meta, f"WITH {BOX} SELECT 'POINT' AS shape_type, min(x0) AS x0, max(y1) AS y1, count(*) AS n FROM part_box"),
    "drivers": (lambda spark, d: st_drivers(spark), ""),
    "crs_list": (lambda spark, d: st_list_proj_crs(spark), ""),
}

QUERIES: dict = {name: _query(spark_sql) for name, (spark_sql, _) in SQL.items()} | {name: f for name, (f, _) in FRAMES.items()}
ORACLE_SQL: dict = {name: sql for name, (_, sql) in (SQL | FRAMES).items() if sql}
