"""SQL functions over the columnar types: structs and arrays that Catalyst sees through.

Each is a SQL function that is inlined into the query's plan, so it runs inside
whole-stage code generation, and filters on coordinates reach the scan.
POINT_2D is struct<x,y>, LINESTRING_2D an array of it, POLYGON_2D an array of rings
(shell first), BOX_2D struct<min_x,min_y,max_x,max_y>."""

P2, P3, P4 = "STRUCT<x:DOUBLE,y:DOUBLE>", "STRUCT<x:DOUBLE,y:DOUBLE,z:DOUBLE>", "STRUCT<x:DOUBLE,y:DOUBLE,z:DOUBLE,m:DOUBLE>"
LINE, POLY = f"ARRAY<{P2}>", f"ARRAY<ARRAY<{P2}>>"
BOX, BOX_F = "STRUCT<min_x:DOUBLE,min_y:DOUBLE,max_x:DOUBLE,max_y:DOUBLE>", "STRUCT<min_x:FLOAT,min_y:FLOAT,max_x:FLOAT,max_y:FLOAT>"

_SEGMENTS = "zip_with(slice({l}, 1, greatest(size({l}) - 1, 0)), slice({l}, 2, greatest(size({l}) - 1, 0)), (a, b) -> {f})"
_SUM = "aggregate({x}, 0D, (s, v) -> s + v)"


def _over(line: str, f: str) -> str:
    return _SUM.format(x=_SEGMENTS.format(l=line, f=f))


_LEN = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_CROSS = "(a.x * b.y - b.x * a.y)"
#: twice the signed area, about the ring's first vertex
_RING2 = _over("{l}", "((a.x - {l}[0].x) * (b.y - {l}[0].y) - (b.x - {l}[0].x) * (a.y - {l}[0].y))")
_RAD = "6371000D"
_PT_SEG = """sqrt(CASE WHEN (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) < 1e-12 THEN ({q}.x - a.x) * ({q}.x - a.x) + ({q}.y - a.y) * ({q}.y - a.y)
 ELSE pow({q}.x - a.x - least(1D, greatest(0D, (({q}.x - a.x) * (b.x - a.x) + ({q}.y - a.y) * (b.y - a.y)) / ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)))) * (b.x - a.x), 2)
    + pow({q}.y - a.y - least(1D, greatest(0D, (({q}.x - a.x) * (b.x - a.x) + ({q}.y - a.y) * (b.y - a.y)) / ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)))) * (b.y - a.y), 2) END)"""


def _distance(q: str, line: str) -> str:
    return f"CASE WHEN {line} IS NULL OR {q} IS NULL OR size({line}) = 0 THEN NULL WHEN size({line}) = 1 THEN sqrt(pow({q}.x - {line}[0].x, 2) + pow({q}.y - {line}[0].y, 2)) ELSE array_min({_SEGMENTS.format(l=line, f=_PT_SEG.format(q=q))}) END"


_WKT_PT = "concat({p}.x, ' ', {p}.y)"
_NUM = "IF({v} = CAST({v} AS BIGINT), CAST(CAST({v} AS BIGINT) AS STRING), CAST({v} AS STRING))"


def _wkt_points(line: str) -> str:
    return f"array_join(transform({line}, p -> concat({_NUM.format(v='p.x')}, ' ', {_NUM.format(v='p.y')})), ', ')"


_CENTRE_LINE = f"""CASE WHEN l IS NULL OR size(l) = 0 THEN NULL WHEN {_over('l', _LEN)} = 0 THEN l[0] ELSE named_struct(
 'x', {_over('l', f'(a.x + b.x) / 2 * {_LEN}')} / {_over('l', _LEN)}, 'y', {_over('l', f'(a.y + b.y) / 2 * {_LEN}')} / {_over('l', _LEN)}) END"""


def _centre_polygon() -> str:
    """Area-weighted; the shell's area counts, holes' areas are taken off, whatever their winding."""
    def ring(axis: str) -> str:
        return _over("r", f"((a.{axis} - p[0][0].{axis}) + (b.{axis} - p[0][0].{axis})) * ((a.x - p[0][0].x) * (b.y - p[0][0].y) - (b.x - p[0][0].x) * (a.y - p[0][0].y))")

    area2 = _RING2.format(l="r")
    total = lambda value: f"aggregate(transform(p, (r, i) -> IF(i = 0, 1, -1) * sign({area2}) * {value}), 0D, (s, v) -> s + v)"
    return f"""CASE WHEN p IS NULL OR size(p) = 0 OR size(p[0]) = 0 THEN NULL ELSE named_struct('x', p[0][0].x + {total(ring('x'))} / (3 * {total(area2)}), 'y', p[0][0].y + {total(ring('y'))} / (3 * {total(area2)})) END"""


_DEDUPE = """CASE WHEN l IS NULL OR size(l) < 3 THEN l ELSE aggregate(slice(l, 2, size(l) - 1), array(l[0]),
 (k, v) -> IF(pow(v.x - element_at(k, -1).x, 2) + pow(v.y - element_at(k, -1).y, 2) > tolerance * tolerance, concat(k, array(v)), k),
 k -> IF(size(k) = 1, concat(k, array(element_at(l, -1))), concat(slice(k, 1, size(k) - 1), array(element_at(l, -1))))) END"""

#: name: (parameters, result, body)
FUNCTIONS = {
    "st_point2d": ("x DOUBLE, y DOUBLE", P2, "IF(x IS NULL OR y IS NULL, NULL, named_struct('x', x, 'y', y))"),
    "st_point3d": ("x DOUBLE, y DOUBLE, z DOUBLE", P3, "IF(x IS NULL OR y IS NULL OR z IS NULL, NULL, named_struct('x', x, 'y', y, 'z', z))"),
    "st_point4d": ("x DOUBLE, y DOUBLE, z DOUBLE, m DOUBLE", P4, "IF(x IS NULL OR y IS NULL OR z IS NULL OR m IS NULL, NULL, named_struct('x', x, 'y', y, 'z', z, 'm', m))"),
    "st_box2d": ("min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE", BOX, "named_struct('min_x', min_x, 'min_y', min_y, 'max_x', max_x, 'max_y', max_y)"),
    "st_point3d_to_point2d": (f"p {P3}", P2, "IF(p IS NULL, NULL, named_struct('x', p.x, 'y', p.y))"),
    "st_point4d_to_point2d": (f"p {P4}", P2, "IF(p IS NULL, NULL, named_struct('x', p.x, 'y', p.y))"),
    "st_x_point2d": (f"p {P2}", "DOUBLE", "p.x"),
    "st_y_point2d": (f"p {P2}", "DOUBLE", "p.y"),
    **{f"st_{o}{e}_box2d": (f"b {BOX}", "DOUBLE", f"b.{e}_{o}") for o in "xy" for e in ("min", "max")},
    **{f"st_{o}{e}_box2df": (f"b {BOX_F}", "FLOAT", f"b.{e}_{o}") for o in "xy" for e in ("min", "max")},
    **{f"st_{o}{e}_point2d": (f"p {P2}", "DOUBLE", f"p.{o}") for o in "xy" for e in ("min", "max")},
    **{f"st_{o}{e}_linestring2d": (f"l {LINE}", "DOUBLE", f"array_{e}(transform(l, p -> p.{o}))") for o in "xy" for e in ("min", "max")},
    **{f"st_{o}{e}_polygon2d": (f"p {POLY}", "DOUBLE", f"array_{e}(transform(get(p, 0), v -> v.{o}))") for o in "xy" for e in ("min", "max")},
    **{f"st_geometrytype_{t}": (f"g {kind}", "STRING", f"IF(g IS NULL, NULL, '{n}')") for t, kind, n in (("point2d", P2, "POINT"), ("linestring2d", LINE, "LINESTRING"), ("polygon2d", POLY, "POLYGON"))},
    "st_isempty_linestring2d": (f"l {LINE}", "BOOLEAN", "size(l) = 0"),
    "st_isempty_polygon2d": (f"p {POLY}", "BOOLEAN", "size(p) = 0"),
    "st_npoints_point2d": (f"p {P2}", "BIGINT", "IF(p IS NULL, NULL, 1L)"),
    "st_npoints_linestring2d": (f"l {LINE}", "BIGINT", "IF(l IS NULL, NULL, CAST(size(l) AS BIGINT))"),
    "st_npoints_polygon2d": (f"p {POLY}", "BIGINT", "aggregate(p, 0L, (s, r) -> s + size(r))"),
    "st_npoints_box2d": (f"b {BOX}", "BIGINT", "IF(b IS NULL, NULL, 4L)"),
    "st_ninteriorrings_polygon2d": (f"p {POLY}", "INT", "IF(p IS NULL, NULL, greatest(size(p) - 1, 0))"),
    "st_exteriorring_polygon2d": (f"p {POLY}", LINE, "IF(p IS NULL, NULL, coalesce(get(p, 0), slice(flatten(p), 1, 0)))"),
    "st_startpoint_linestring2d": (f"l {LINE}", P2, "get(l, 0)"),
    "st_endpoint_linestring2d": (f"l {LINE}", P2, "get(l, size(l) - 1)"),
    "st_pointn_linestring2d": (f"l {LINE}, n INT", P2, "IF(n = 0, NULL, get(l, IF(n < 0, size(l) + n, n - 1)))"),
    "st_length_linestring2d": (f"l {LINE}", "DOUBLE", _over("l", _LEN)),
    "st_perimeter_box2d": (f"b {BOX}", "DOUBLE", "2 * ((b.max_x - b.min_x) + (b.max_y - b.min_y))"),
    "st_perimeter_polygon2d": (f"p {POLY}", "DOUBLE", f"aggregate(p, 0D, (t, r) -> t + {_over('r', _LEN)})"),
    "st_area_point2d": (f"p {P2}", "DOUBLE", "IF(p IS NULL, NULL, 0D)"),
    "st_area_linestring2d": (f"l {LINE}", "DOUBLE", "IF(l IS NULL, NULL, 0D)"),
    "st_area_box2d": (f"b {BOX}", "DOUBLE", "(b.max_x - b.min_x) * (b.max_y - b.min_y)"),
    "st_area_polygon2d": (f"p {POLY}", "DOUBLE", f"aggregate(transform(p, (r, i) -> IF(i = 0, 1, -1) * abs({_RING2.format(l='r')}) / 2), 0D, (s, v) -> s + v)"),
    "st_centroid_point2d": (f"p {P2}", P2, "p"),
    "st_centroid_box2d": (f"b {BOX}", P2, "IF(b IS NULL, NULL, named_struct('x', (b.min_x + b.max_x) / 2, 'y', (b.min_y + b.max_y) / 2))"),
    "st_centroid_box2df": (f"b {BOX_F}", P2, "IF(b IS NULL, NULL, named_struct('x', (CAST(b.min_x AS DOUBLE) + b.max_x) / 2, 'y', (CAST(b.min_y AS DOUBLE) + b.max_y) / 2))"),
    "st_centroid_linestring2d": (f"l {LINE}", P2, _CENTRE_LINE),
    "st_centroid_polygon2d": (f"p {POLY}", P2, _centre_polygon()),
    "st_distance_point2d": (f"p {P2}, q {P2}", "DOUBLE", "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"),
    "st_distance_point2d_linestring2d": (f"q {P2}, l {LINE}", "DOUBLE", _distance("q", "l")),
    "st_distance_linestring2d_point2d": (f"l {LINE}, q {P2}", "DOUBLE", _distance("q", "l")),
    "st_intersects_box2d": (f"a {BOX}, b {BOX}", "BOOLEAN", "a.min_x <= b.max_x AND a.max_x >= b.min_x AND a.min_y <= b.max_y AND a.max_y >= b.min_y"),
    "st_removerepeatedpoints_linestring2d": (f"l {LINE}, tolerance DOUBLE DEFAULT 0D", LINE, _DEDUPE),
    "st_flipcoordinates_point2d": (f"p {P2}", P2, "IF(p IS NULL, NULL, named_struct('x', p.y, 'y', p.x))"),
    "st_flipcoordinates_linestring2d": (f"l {LINE}", LINE, "transform(l, p -> named_struct('x', p.y, 'y', p.x))"),
    "st_flipcoordinates_polygon2d": (f"p {POLY}", POLY, "transform(p, r -> transform(r, v -> named_struct('x', v.y, 'y', v.x)))"),
    "st_flipcoordinates_box2d": (f"b {BOX}", BOX, "IF(b IS NULL, NULL, named_struct('min_x', b.min_y, 'min_y', b.min_x, 'max_x', b.max_y, 'max_y', b.max_x))"),
    "st_distance_sphere_point2d": (f"p {P2}, q {P2}", "DOUBLE", f"2 * {_RAD} * asin(least(1D, sqrt(pow(sin(radians(q.x - p.x) / 2), 2) + cos(radians(p.x)) * cos(radians(q.x)) * pow(sin(radians(q.y - p.y) / 2), 2))))"),
    "st_astext_point2d": (f"p {P2}", "STRING", f"IF(isnan(p.x) AND isnan(p.y), 'POINT EMPTY', concat('POINT (', {_NUM.format(v='p.x')}, ' ', {_NUM.format(v='p.y')}, ')'))"),
    "st_astext_linestring2d": (f"l {LINE}", "STRING", f"IF(size(l) = 0, 'LINESTRING EMPTY', concat('LINESTRING (', {_wkt_points('l')}, ')'))"),
    "st_astext_polygon2d": (f"p {POLY}", "STRING", f"IF(size(p) = 0, 'POLYGON EMPTY', concat('POLYGON (', array_join(transform(p, r -> concat('(', {_wkt_points('r')}, ')')), ', '), ')'))"),
    "st_astext_box2d": (f"b {BOX}", "STRING", f"concat('BOX(', {_NUM.format(v='b.min_x')}, ' ', {_NUM.format(v='b.min_y')}, ', ', {_NUM.format(v='b.max_x')}, ' ', {_NUM.format(v='b.max_y')}, ')')"),
    "st_extent_linestring2d": (f"l {LINE}", BOX, "IF(l IS NULL OR size(l) = 0, NULL, named_struct('min_x', array_min(transform(l, p -> p.x)), 'min_y', array_min(transform(l, p -> p.y)), 'max_x', array_max(transform(l, p -> p.x)), 'max_y', array_max(transform(l, p -> p.y))))"),
    "st_geometry_point2d": (f"p {P2}", "BINARY", "st_point(p.x, p.y)"),
    "st_geometry_linestring2d": (f"l {LINE}", "BINARY", "IF(size(l) = 0, st_geomfromtext('LINESTRING EMPTY'), st_makeline_list(transform(l, p -> st_point(p.x, p.y))))"),
    "st_geometry_polygon2d": (f"p {POLY}", "BINARY", "IF(size(p) = 0, st_geomfromtext('POLYGON EMPTY'), st_makepolygon_holes(st_makeline_list(transform(p[0], v -> st_point(v.x, v.y))), transform(slice(p, 2, size(p)), r -> st_makeline_list(transform(r, v -> st_point(v.x, v.y))))))"),
    "st_geometry_box2d": (f"b {BOX}", "BINARY", "st_makeenvelope(b.min_x, b.min_y, b.max_x, b.max_y)"),
    "st_geometry_box2df": (f"b {BOX_F}", "BINARY", "st_makeenvelope(CAST(b.min_x AS DOUBLE), CAST(b.min_y AS DOUBLE), CAST(b.max_x AS DOUBLE), CAST(b.max_y AS DOUBLE))"),
    "st_point2d_from_geometry": ("g BINARY", P2, "IF(g IS NULL, NULL, named_struct('x', st_x(g), 'y', st_y(g)))"),
    "st_linestring2d_from_geometry": ("g BINARY", LINE, "IF(st_geometrytype(g) <> 'LINESTRING', raise_error('the geometry is no LINESTRING'), transform(st_dump(st_points(g)), d -> named_struct('x', st_x(d.geom), 'y', st_y(d.geom))))"),
    "st_polygon2d_from_geometry": ("g BINARY", POLY, "IF(st_geometrytype(g) <> 'POLYGON', raise_error('the geometry is no POLYGON'), IF(st_isempty(g), slice(array(array(named_struct('x', 0D, 'y', 0D))), 1, 0), transform(st_dump(_st_rings(g)), r -> transform(st_dump(st_points(r.geom)), d -> named_struct('x', st_x(d.geom), 'y', st_y(d.geom))))))"),
    "st_point2dfromwkb": ("w BINARY", P2, "st_point2d_from_geometry(st_geomfromwkb(w))"),
    "st_linestring2dfromwkb": ("w BINARY", LINE, "st_linestring2d_from_geometry(st_geomfromwkb(w))"),
    "st_polygon2dfromwkb": ("w BINARY", POLY, "st_polygon2d_from_geometry(st_geomfromwkb(w))"),
    "st_distance_spheroid_point2d": (f"p {P2}, q {P2}", "DOUBLE", "st_distance_spheroid(st_point(p.x, p.y), st_point(q.x, q.y))"),
    "st_dwithin_spheroid_point2d": (f"p {P2}, q {P2}, d DOUBLE", "BOOLEAN", "st_dwithin_spheroid(st_point(p.x, p.y), st_point(q.x, q.y), d)"),
    "st_length_spheroid_linestring2d": (f"l {LINE}", "DOUBLE", "st_length_spheroid(st_geometry_linestring2d(l))"),
    "st_perimeter_spheroid_polygon2d": (f"p {POLY}", "DOUBLE", "st_perimeter_spheroid(st_geometry_polygon2d(p))"),
    "st_area_spheroid_polygon2d": (f"p {POLY}", "DOUBLE", "st_area_spheroid(st_geometry_polygon2d(p))"),
    "st_hilbert_box2d": (f"b {BOX}, bounds {BOX}", "BIGINT", "st_hilbert_xy(b.min_x + (b.max_x - b.min_x) / 2, b.min_y + (b.max_y - b.min_y) / 2, bounds)"),
    "st_isvalid_linestring2d": (f"l {LINE}", "BOOLEAN", "IF(size(l) = 1, false, st_isvalid(st_geometry_linestring2d(l)))"),
    "st_isvalid_polygon2d": (f"p {POLY}", "BOOLEAN", "IF(exists(p, r -> size(r) < 4 OR get(r, 0) <> get(r, size(r) - 1)), false, st_isvalid(st_geometry_polygon2d(p)))"),
    # optional arguments of the JVM functions
    "st_geomfromtext": ("wkt STRING, ignore_invalid BOOLEAN DEFAULT false", "BINARY", "_st_geomfromtext(wkt, ignore_invalid)"),
    "st_assvg": ("g BINARY, rel BOOLEAN DEFAULT false, digits INT DEFAULT 15", "STRING", "_st_assvg(g, rel, digits)"),
    "st_force3dz": ("g BINARY, z DOUBLE DEFAULT 0D", "BINARY", "_st_force3dz(g, z)"),
    "st_force3dm": ("g BINARY, m DOUBLE DEFAULT 0D", "BINARY", "_st_force3dm(g, m)"),
    "st_force4d": ("g BINARY, z DOUBLE DEFAULT 0D, m DOUBLE DEFAULT 0D", "BINARY", "_st_force4d(g, z, m)"),
    "st_buffer": ("g BINARY, distance DOUBLE, segments INT DEFAULT 8, cap STRING DEFAULT 'CAP_ROUND', join_style STRING DEFAULT 'JOIN_ROUND', mitre DOUBLE DEFAULT 5D", "BINARY", "_st_buffer(g, distance, segments, cap, join_style, mitre)"),
    "st_removerepeatedpoints": ("g BINARY, tolerance DOUBLE DEFAULT 0D", "BINARY", "_st_removerepeatedpoints(g, tolerance)"),
    "st_linemerge": ("g BINARY, directed BOOLEAN DEFAULT false", "BINARY", "_st_linemerge(g, directed)"),
    "st_transform": ("g BINARY, source STRING, target STRING, always_xy BOOLEAN DEFAULT false", "BINARY", "_st_transform(g, source, target, always_xy)"),
    "st_transform_point2d": (f"p {P2}, source STRING, target STRING, always_xy BOOLEAN DEFAULT false", P2, "_st_transform_point2d(p, source, target, always_xy)"),
    "st_transform_box2d": (f"b {BOX}, source STRING, target STRING, always_xy BOOLEAN DEFAULT false", BOX, "_st_transform_box2d(b, source, target, always_xy)"),
}
#: functions that others call come first
ORDER = sorted(FUNCTIONS, key=lambda n: (("st_geometry_" in n or "_from_geometry" in n) + 2 * ("spheroid" in n or "fromwkb" in n or "isvalid" in n), n))
