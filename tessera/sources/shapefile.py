"""ESRI shapefiles: a parser of .shp and .dbf, and writers of both."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

SHAPES = {0: "NULL", 1: "POINT", 3: "LINESTRING", 5: "POLYGON", 8: "MULTIPOINT", 11: "POINTZ", 13: "LINESTRINGZ", 15: "POLYGONZ", 18: "MULTIPOINTZ", 21: "POINTM", 23: "LINESTRINGM", 25: "POLYGONM", 28: "MULTIPOINTM", 31: "MULTIPATCH"}
SUPPORTED = (0, 1, 3, 5, 8)


def header(shp: bytes) -> tuple[int, tuple[float, float, float, float]]:
    """Shape type and bounds."""
    if len(shp) < 100 or struct.unpack(">i", shp[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    return struct.unpack("<i", shp[32:36])[0], struct.unpack("<4d", shp[36:68])


def _wkb_line(points: bytes) -> bytes:
    return struct.pack("<I", len(points) // 16) + points


def _signed_area(points: bytes) -> float:
    v = struct.unpack(f"<{len(points) // 8}d", points)
    return sum(v[i] * v[i + 3] - v[i + 2] * v[i + 1] for i in range(0, len(v) - 2, 2)) / 2


def geometry(record: bytes) -> bytes | None:
    """WKB of a record's content."""
    kind = struct.unpack("<i", record[:4])[0]
    if kind == 0:
        return None
    if kind == 1:
        return b"\x01\x01\x00\x00\x00" + record[4:20]
    if kind == 8:
        n = struct.unpack("<i", record[36:40])[0]
        return b"\x01\x04\x00\x00\x00" + struct.pack("<I", n) + b"".join(b"\x01\x01\x00\x00\x00" + record[40 + 16 * i : 56 + 16 * i] for i in range(n))
    if kind not in (3, 5):
        raise ValueError(f"shape type {SHAPES.get(kind, kind)} is not supported")
    n_parts, n_points = struct.unpack("<2i", record[36:44])
    starts = [*struct.unpack(f"<{n_parts}i", record[44 : 44 + 4 * n_parts]), n_points]
    at = 44 + 4 * n_parts
    parts = [record[at + 16 * a : at + 16 * b] for a, b in zip(starts, starts[1:], strict=False)]
    if kind == 3:
        if len(parts) == 1:
            return b"\x01\x02\x00\x00\x00" + _wkb_line(parts[0])
        return b"\x01\x05\x00\x00\x00" + struct.pack("<I", n_parts) + b"".join(b"\x01\x02\x00\x00\x00" + _wkb_line(p) for p in parts)
    shells = [i for i, p in enumerate(parts) if _signed_area(p) < 0]
    polygon = lambda rings: b"\x01\x03\x00\x00\x00" + struct.pack("<I", len(rings)) + b"".join(map(_wkb_line, rings))
    if len(shells) < 2:
        return polygon(parts)
    cuts = [0, *shells[1:], n_parts]
    return b"\x01\x06\x00\x00\x00" + struct.pack("<I", len(shells)) + b"".join(polygon(parts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))


def shapes(shp: bytes, at: int = 100) -> Iterator[bytes | None]:
    """Geometries of a file, or of its records from a byte on."""
    while at + 8 <= len(shp):
        size = 2 * struct.unpack(">i", shp[at + 4 : at + 8])[0]
        yield geometry(shp[at + 8 : at + 8 + size])
        at += 8 + size


def fields(dbf: bytes) -> list[tuple[str, str, int, int]]:
    """Name, DBF type, width, decimals."""
    out, at = [], 32
    while dbf[at] != 0x0D:
        name = dbf[at : at + 11].split(b"\x00")[0].decode("latin-1")
        out.append((name, chr(dbf[at + 11]), dbf[at + 16], dbf[at + 17]))
        at += 32
    return out


def spark_type(kind: str, width: int, decimals: int, encoding: str) -> str:
    if kind in "NF":
        return "int" if kind == "N" and decimals == 0 and width < 10 else "bigint" if decimals == 0 and width < 19 else "double"
    return {"D": "date", "L": "boolean"}.get(kind, "binary" if encoding == "blob" else "string")


def attributes(dbf: bytes, encoding: str) -> Iterator[list]:
    n, start, size = struct.unpack("<IHH", dbf[4:12])
    yield from records(dbf, dbf[start : start + n * size], encoding)


def records(dbf_head: bytes, data: bytes, encoding: str) -> Iterator[list]:
    """Rows of whole records of a DBF, by its header."""
    own, size = fields(dbf_head), struct.unpack("<H", dbf_head[10:12])[0]
    for i in range(len(data) // size):
        row, at = [], i * size + 1
        for _, kind, width, decimals in own:
            raw = data[at : at + width]
            at += width
            to = spark_type(kind, width, decimals, encoding)
            text = raw.strip(b" \x00")
            if not text or (kind in "NF" and text.startswith(b"*")) or (kind == "D" and text == b"00000000") or (kind == "L" and text == b"?"):
                row.append(None)
            elif to in ("int", "bigint"):
                row.append(int(float(text)))
            elif to == "double":
                row.append(float(text))
            elif to == "date":
                row.append(datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])))
            elif to == "boolean":
                row.append(text == b"T")
            elif to == "binary":
                row.append(bytes(raw.rstrip(b" \x00")))
            else:
                try:
                    row.append(raw.rstrip(b" \x00").decode("latin-1" if encoding == "iso-8859-1" else "utf-8"))
                except UnicodeDecodeError as e:
                    raise ValueError("text is not valid UTF-8; try encoding='blob' or 'iso-8859-1'") from e
        yield row


def _parts_of(wkb: bytes) -> tuple[int, list[bytes]]:
    """Shape type and parts (runs of x, y) of a two-dimensional little-endian WKB."""
    kind, at = struct.unpack("<I", wkb[1:5])[0], 5

    def run(at):
        n = struct.unpack("<I", wkb[at : at + 4])[0]
        return wkb[at + 4 : at + 4 + 16 * n], at + 4 + 16 * n

    if kind == 1:
        return 1, [wkb[5:21]]
    if kind == 2:
        return 3, [run(at)[0]]
    if kind not in (3, 4, 5, 6):
        raise ValueError("a shapefile takes points, lines and polygons of two dimensions")
    n, at, out = struct.unpack("<I", wkb[5:9])[0], 9, []
    if kind == 4:
        return 8, [b"".join(wkb[9 + 21 * i + 5 : 9 + 21 * i + 21] for i in range(n))]
    for _ in range(n):
        rings = 1
        if kind == 5:
            at += 5
        elif kind == 6:
            rings = struct.unpack("<I", wkb[at + 5 : at + 9])[0]
            at += 9
        for j in range(rings):
            part, at = run(at)
            shell = kind == 6 and j == 0 or kind == 3 and not out
            if kind in (3, 6) and (_signed_area(part) < 0) != shell:  # shells clockwise, holes not
                v = [part[k : k + 16] for k in range(0, len(part), 16)]
                part = b"".join(reversed(v))
            out.append(part)
    return (3 if kind == 5 else 5), out


def write(geometries: list[bytes | None], rows: list[list], names: list[str], kinds: list[str]) -> tuple[bytes, bytes, bytes]:
    """.shp, .shx and .dbf of one part."""
    records, index, shape, bounds = [], [], 0, [float("inf"), float("inf"), float("-inf"), float("-inf")]
    at = 50
    for i, wkb in enumerate(geometries):
        if wkb is None:
            body = struct.pack("<i", 0)
        else:
            kind, parts = _parts_of(wkb)
            if shape not in (0, kind):
                raise ValueError("a shapefile holds one kind of shapes")
            shape = kind
            flat = b"".join(parts)
            v = struct.unpack(f"<{len(flat) // 8}d", flat)
            box = (min(v[::2]), min(v[1::2]), max(v[::2]), max(v[1::2])) if v else (0.0,) * 4
            bounds = [*map(min, bounds[:2], box[:2]), *map(max, bounds[2:], box[2:])]
            if kind == 1:
                body = struct.pack("<i", 1) + flat
            elif kind == 8:
                body = struct.pack("<i4di", 8, *box, len(flat) // 16) + flat
            else:
                starts, n = [], 0
                for p in parts:
                    starts.append(n)
                    n += len(p) // 16
                body = struct.pack(f"<i4d2i{len(parts)}i", kind, *box, len(parts), n, *starts) + flat
        records.append(struct.pack(">2i", i + 1, len(body) // 2) + body)
        index.append(struct.pack(">2i", at, len(body) // 2))
        at += len(records[-1]) // 2
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, shape, *(bounds if bounds[0] <= bounds[2] else [0.0] * 4), 0, 0, 0, 0)
    spec = []
    for name, kind in zip(names, kinds, strict=True):
        letter, width, decimals = {"int": ("N", 9, 0), "bigint": ("N", 18, 0), "double": ("N", 24, 15), "float": ("N", 24, 15), "boolean": ("L", 1, 0), "date": ("D", 8, 0)}.get(kind, ("C", 254, 0))
        spec.append((name.encode()[:10], letter, width, decimals))
    dbf = [b""]
    for row in rows:
        dbf.append(b" ")
        for value, (_, letter, width, decimals) in zip(row, spec, strict=True):
            text = "" if value is None else {"N": lambda v=value, d=decimals: f"{v:.{d}f}" if d else str(int(v)), "L": lambda v=value: "T" if v else "F", "D": lambda v=value: v.strftime("%Y%m%d")}.get(letter, lambda v=value: str(v))()
            raw = text.encode()
            if len(raw) > width:
                raise ValueError(f"a value is longer than the {width} bytes that a DBF field holds")
            dbf.append(raw.rjust(width) if letter == "N" else raw.ljust(width))
    size = 1 + sum(w for _, _, w, _ in spec)
    dbf[0] = struct.pack("<4BIHH20x", 3, 95, 1, 1, len(rows), 33 + 32 * len(spec), size) + b"".join(struct.pack("<11sc4xBB14x", n, k.encode(), w, d) for n, k, w, d in spec) + b"\r"
    return head(at) + b"".join(records), head(50 + 4 * len(index)) + b"".join(index), b"".join(dbf) + b"\x1a"


def piece(geometries: list[bytes | None], rows: list[list], names: list[str], kinds: list[str]) -> tuple[int, int, tuple[float, float, float, float], bytes, bytes, bytes]:
    """Some records of a file: their number, shape type, bounds, and what stands for them in .shp, .shx and .dbf, as if they were the first."""
    shp, shx, dbf = write(geometries, rows, names, kinds)
    return len(geometries), *header(shp), shp[100:], shx[100:], dbf[struct.unpack("<H", dbf[8:10])[0] : -1]


def placed(shp: bytes, shx: bytes, number: int, offset: int) -> tuple[bytes, bytes]:
    """A piece's records with their numbers (from number on) and their offsets (in words, of the first)."""
    import numpy as np

    index = np.frombuffer(shx, ">i4").reshape(-1, 2).astype(np.int64)
    data = np.frombuffer(shp, np.uint8).copy()
    numbers = np.arange(number, number + len(index)).astype(">i4").view(np.uint8).reshape(-1, 4)
    data[(2 * index[:, :1] - 100) + np.arange(4)] = numbers
    index[:, 0] += offset - 50
    return data.tobytes(), index.astype(">i4").tobytes()


def heads(shape: int, bounds: list[float] | None, n: int, size: int, names: list[str], kinds: list[str]) -> tuple[bytes, bytes, bytes]:
    """Headers of .shp (size: the bytes of its records), .shx and .dbf of n records."""
    if (100 + size) // 2 >= 1 << 31:
        raise ValueError("a shapefile holds 4 GB at most")
    shp, shx, dbf = write([], [], names, kinds)
    tail = struct.pack("<i4d", shape, *(bounds or [0.0] * 4))
    head = lambda words, old: old[:24] + struct.pack(">i", words) + old[28:32] + tail + old[68:100]
    return head((100 + size) // 2, shp), head(50 + 4 * n, shx), dbf[:4] + struct.pack("<I", n) + dbf[8:-1]
