"""The JVM functions: SQL name, argument codes, result, Java expression over a, b, c, ...

Codes: g geometry (WKB), d double, i int, n long, s string, b boolean, l array of geometries, p POLYGON_2D, r struct, w WKB."""

BOX = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"
BOX_F = "struct<min_x:float,min_y:float,max_x:float,max_y:float>"
POINT = "struct<x:double,y:double>"

FUNCTIONS = [
    # codecs
    ("_st_geomfromtext", "sb", "binary", "Geo.fromText(a, b)"),
    ("st_geomfromwkb", "g", "binary", "Geo.fromWkb(a)"),
    ("st_geomfromhexwkb", "s", "binary", "Geo.fromHex(a)"),
    ("st_geomfromhexewkb", "s", "binary", "Geo.fromHex(a)"),
    ("st_geomfromgeojson", "s", "binary", "Geo.fromGeoJson(a)"),
    ("st_astext", "g", "string", "Geo.asText(a)"),
    ("st_aswkb", "g", "binary", "a"),
    ("st_ashexwkb", "g", "string", "Geo.hex(a)"),
    ("st_asgeojson", "g", "string", "Geo.asGeoJson(a)"),
    ("_st_assvg", "gbi", "string", "Geo.asSvg(a, b, c)"),
    # constructors
    ("st_point", "dd", "binary", "Geo.point(a, b)"),
    ("st_makeenvelope", "dddd", "binary", "Geo.envelope(a, b, c, d)"),
    ("st_makeline", "gg", "binary", "Geo.makeLine(a, b)"),
    ("st_makeline_list", "l", "binary", "Geo.makeLine(a)"),
    ("st_makepolygon", "g", "binary", "Geo.makePolygon(a)"),
    ("st_makepolygon_holes", "gl", "binary", "Geo.makePolygon(a, b)"),
    ("st_collect", "l", "binary", "Geo.collect(a)"),
    ("st_multi", "g", "binary", "Geo.multi(a)"),
    ("st_dump", "g", "array<struct<geom:binary,path:array<int>>>", "Geo.dump(a)"),
    ("st_collectionextract", "g", "binary", "Geo.collectionExtract(a)"),
    ("st_collectionextract_type", "gi", "binary", "Geo.collectionExtract(a, b)"),
    ("st_points", "g", "binary", "Geo.points(a)"),
    ("st_force2d", "g", "binary", "Geo.force(a, null, null)"),
    ("_st_force3dz", "gd", "binary", "Geo.force(a, b, null)"),
    ("_st_force3dm", "gd", "binary", "Geo.force(a, null, b)"),
    ("_st_force4d", "gdd", "binary", "Geo.force(a, b, c)"),
    ("st_flipcoordinates", "g", "binary", "Geo.flip(a)"),
    ("st_extent", "g", BOX, "Geo.extent(a)"),
    ("st_extent_wkb", "g", BOX, "Geo.extentWkb(a)"),
    ("st_extent_polygon2d", "p", BOX, "Geo.extentRings(a)"),
    ("st_contains_polygon2d", "pr", "boolean", "Geo.insideRings(a, b)"),
    ("st_within_point2d", "rp", "boolean", "Geo.insideRings(b, a)"),
    ("st_extent_approx", "g", BOX_F, "Geo.extentApprox(a)"),
    # accessors and measures
    *[(f"st_{n}", "g", "double", f"Geo.ordinate(a, {i})") for i, n in enumerate("xyzm")],
    *[(f"st_{n}{end}", "g", "double", f"Geo.bound(a, {i}, {'true' if end == 'max' else 'false'})") for i, n in enumerate("xyzm") for end in ("min", "max")],
    ("st_geometrytype", "g", "string", "Geo.type(a)"),
    ("st_dimension", "g", "int", "Geo.dimension(a)"),
    ("st_hasz", "g", "boolean", "Geo.flags(a) >= 2"),
    ("st_hasm", "g", "boolean", "Geo.flags(a) % 2 == 1"),
    ("st_zmflag", "g", "int", "Geo.flags(a)"),
    ("st_isempty", "g", "boolean", "Geo.isEmpty(a)"),
    ("st_isclosed", "g", "boolean", "Geo.isClosed(a)"),
    *[(n, "g", "long", "Geo.nPoints(a)") for n in ("st_npoints", "st_numpoints")],
    *[(n, "g", "int", "Geo.nGeometries(a)") for n in ("st_ngeometries", "st_numgeometries")],
    *[(n, "g", "int", "Geo.nInteriorRings(a)") for n in ("st_ninteriorrings", "st_numinteriorrings")],
    ("st_exteriorring", "g", "binary", "Geo.exteriorRing(a)"),
    ("st_startpoint", "g", "binary", "Geo.pointN(a, 1)"),
    ("st_endpoint", "g", "binary", "Geo.pointN(a, -1)"),
    ("st_pointn", "gi", "binary", "Geo.pointN(a, b)"),
    ("st_length", "g", "double", "Geo.length(a)"),
    ("st_perimeter", "g", "double", "Geo.perimeter(a)"),
    ("st_area", "g", "double", "Geo.area(a)"),
    ("st_intersects_extent", "gg", "boolean", "Geo.intersectsExtent(a, b)"),
    ("st_hilbert", "gr", "long", "Geo.hilbert(a, b)"),
    ("st_hilbert_world", "g", "long", "Geo.hilbert(a)"),
    ("st_hilbert_xy", "ddr", "long", "Geo.hilbert(a, b, c)"),
    ("st_hilbert_box2df", "rr", "long", "Geo.hilbertF(a, b)"),
    ("st_quadkey", "gi", "string", "Geo.quadKey(a, b)"),
    ("st_quadkey_xy", "ddi", "string", "Geo.quadKey(a, b, c)"),
    # topology
    *[(f"st_{n}", "gg", "boolean", f'Geo.relate(a, b, "{n}")') for n in ("equals", "intersects", "disjoint", "touches", "crosses", "overlaps", "contains", "within", "covers", "coveredby", "containsproperly")],
    ("st_dwithin", "ggd", "boolean", "Geo.within(a, b, c)"),
    ("st_distance", "gg", "double", "Geo.distance(a, b)"),
    ("st_shortestline", "gg", "binary", "Geo.shortestLine(a, b)"),
    ("st_intersection", "gg", "binary", "Geo.overlay(a, b, 1)"),
    ("st_union", "gg", "binary", "Geo.overlay(a, b, 2)"),
    ("st_difference", "gg", "binary", "Geo.overlay(a, b, 3)"),
    ("_st_buffer", "gdissd", "binary", "Geo.buffer(a, b, c, d, e, f)"),
    ("st_boundary", "g", "binary", "Geo.boundary(a)"),
    *[(n, "g", "binary", f'Geo.unary(a, "{what}")') for n, what in (("st_centroid", "centroid"), ("st_convexhull", "hull"), ("st_envelope", "envelope"), ("st_pointonsurface", "inside"), ("st_makevalid", "fix"), ("st_normalize", "normal"), ("st_reverse", "reverse"))],
    ("st_isring", "g", "boolean", "Geo.isRing(a)"),
    ("st_issimple", "g", "boolean", "Geo.isSimple(a)"),
    ("st_isvalid", "g", "boolean", "Geo.isValid(a)"),
    ("st_reduceprecision", "gd", "binary", "Geo.reduce(a, b)"),
    ("_st_removerepeatedpoints", "gd", "binary", "Geo.dedupe(a, b)"),
    ("st_simplify", "gd", "binary", "Geo.simplify(a, b, false)"),
    ("st_simplifypreservetopology", "gd", "binary", "Geo.simplify(a, b, true)"),
    ("_st_linemerge", "gb", "binary", "Geo.lineMerge(a, b)"),
    ("st_union_list", "l", "binary", "Geo.unionAll(a)"),
    ("st_intersection_list", "l", "binary", "Geo.intersectAll(a)"),
    # sphere, spheroid, reference systems
    ("st_distance_sphere", "gg", "double", "Geo.sphere(a, b)"),
    ("st_distance_spheroid", "gg", "double", "Geo.spheroid(a, b)"),
    ("st_dwithin_spheroid", "ggd", "boolean", "Geo.spheroid(a, b) <= c"),
    ("st_length_spheroid", "g", "double", "Geo.lengthSpheroid(a)"),
    ("st_perimeter_spheroid", "g", "double", "Geo.polygonSpheroid(a, false)"),
    ("st_area_spheroid", "g", "double", "Geo.polygonSpheroid(a, true)"),
    ("_st_transform", "gssb", "binary", "Geo.transform(a, b, c, d)"),
    ("_st_transform_point2d", "rssb", POINT, "Geo.transformPoint(a, b, c, d)"),
    ("_st_transform_box2d", "rssb", BOX, "Geo.transformBox(a, b, c, d)"),
    ("_st_rings", "g", "binary", "Geo.rings(a)"),
    ("_st_crs_table", "i", "string", "Crs.table()"),
    # ranges of files
    ("_st_file_range", "snn", "binary", "Files.read(a, b, c)"),
    ("_st_file_shapes", "ssnn", "binary", "Files.shapes(a, b, c, d)"),
    ("_st_file_cuts", "sn", "array<bigint>", "Files.cuts(a, b)"),
]

_JAVA = {"g": "byte[]", "d": "Double", "i": "Integer", "n": "Long", "s": "String", "b": "Boolean", "l": "scala.collection.Seq<?>", "p": "scala.collection.Seq<?>", "r": "Row"}
_CAST = {"d": "((Number) {0}).doubleValue()", "i": "((Number) {0}).intValue()", "n": "((Number) {0}).longValue()"}


def class_name(name: str) -> str:
    return "".join(p.capitalize() for p in name.split("_"))


def java_source() -> str:
    out = ["package tessera;", "import org.apache.spark.sql.Row;", "import org.apache.spark.sql.api.java.*;", "/** Written by build.py from spec.py. */", "public final class Udfs {"]
    for name, args, _, body in FUNCTIONS:
        letters = "abcdef"[: len(args)]
        takes = ", ".join(["Object"] * (len(args) + 1))
        params = ", ".join(f"Object {x}_" for x in letters)
        nulls = " || ".join(f"{x}_ == null" for x in letters)
        casts = " ".join(f"{_JAVA[k]} {x} = {_CAST[k].format(x + '_')};" if k in _CAST else f"{_JAVA[k]} {x} = ({_JAVA[k]}) {x}_;" for k, x in zip(args, letters, strict=True))
        out.append(f"  public static final class {class_name(name)} implements UDF{len(args)}<{takes}> {{ public Object call({params}) {{ if ({nulls}) return null; {casts} return {body}; }} }}")
    return "\n".join([*out, "}", ""])
