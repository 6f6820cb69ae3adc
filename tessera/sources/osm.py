"""OpenStreetMap PBF: a decoder of blobs (zlib or raw) to nodes, ways and relations."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

SCHEMA = "kind string, id bigint, tags map<string,string>, refs array<bigint>, lat double, lon double, ref_roles array<string>, ref_types array<string>"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = ("node", "way", "relation")


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def message(b: bytes) -> Iterator[tuple[int, object]]:
    """Field number and value (int or bytes) of a protobuf message."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(b, at)
        elif kind == 2:
            n, at = _varint(b, at)
            value, at = b[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = b[at : at + n], at + n
        yield key >> 3, value


def varints(b: bytes) -> np.ndarray:
    """A packed field, by numpy: bytes below 128 end a number."""
    raw = np.frombuffer(b, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def zigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def blobs(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Kind and content of each blob of a file."""
    at = 0
    while at + 4 <= len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        head = dict(message(data[at + 4 : at + 4 + n]))
        at += 4 + n
        size = head[3]
        yield head[1].decode(), data[at : at + size]
        at += size


def inflate(blob: bytes) -> bytes:
    own = dict(message(blob))
    if 1 in own:
        return own[1]
    if 3 in own:
        return zlib.decompress(own[3])
    raise ValueError("only raw and zlib blobs are supported")


def rows(block: bytes) -> Iterator[tuple]:
    """Rows of a primitive block, in file order."""
    strings, groups, granularity, lat0, lon0 = [], [], 100, 0, 0
    for k, v in message(block):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for i, s in message(v) if i == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            granularity = v
        elif k == 19:
            lat0 = _signed(v)
        elif k == 20:
            lon0 = _signed(v)
    degrees = lambda offset, v: 1e-9 * (offset + granularity * v)

    def tags(keys, values):
        return {strings[int(a)]: strings[int(b)] for a, b in zip(keys, values, strict=True)} or None

    for group in groups:
        for kind, raw in message(group):
            if kind == 2:  # dense nodes
                own = dict(message(raw))
                ids, lats, lons = (np.cumsum(zigzag(varints(own.get(i, b"")))) for i in (1, 8, 9))
                kv = varints(own.get(10, b"")).tolist()
                at = 0
                for i in range(len(ids)):
                    t = {}
                    while at < len(kv) and kv[at]:
                        t[strings[kv[at]]] = strings[kv[at + 1]]
                        at += 2
                    at += 1
                    yield ("node", int(ids[i]), t or None, None, degrees(lat0, int(lats[i])), degrees(lon0, int(lons[i])), None, None)
                continue
            if kind not in (1, 3, 4):
                continue
            own = dict(message(raw))
            t = tags(varints(own.get(2, b"")), varints(own.get(3, b"")))
            if kind == 1:
                fix = lambda x: (x >> 1) ^ -(x & 1)
                yield ("node", fix(own[1]), t, None, degrees(lat0, fix(own[8])), degrees(lon0, fix(own[9])), None, None)
            elif kind == 3:
                refs = np.cumsum(zigzag(varints(own.get(8, b"")))).tolist()
                yield ("way", _signed(own[1]), t, refs or None, None, None, None, None)
            else:
                refs = np.cumsum(zigzag(varints(own.get(9, b"")))).tolist()
                roles = [strings[int(i)] for i in varints(own.get(8, b""))]
                types = [_TYPES[int(i)] for i in varints(own.get(10, b""))]
                yield ("relation", _signed(own[1]), t, refs or None, None, None, roles or None, types or None)
