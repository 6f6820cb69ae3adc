"""SimHash near-dedup by multi-index hashing.

The fingerprint is cut into segments, and each segment has a table: segment and value,
and the distinct fingerprints with it. Two fingerprints at a distance of d or less agree
in some segment to within its radius: the radii are dealt so that, each with one added,
they sum to d + 1 (for d = 2 and two segments: one bit in the first, none in the second).
Each fingerprint enumerates the Hamming ball of that radius around its own value of a
segment, fetches the table's matches under each value, and the complete distance of each
match is verified. A ball is enumerated upwards only, to values not less than the own one,
since the other fingerprint of a pair comes to meet it.

A value that more than HOT fingerprints share is not fetched, since all of its pairs would
meet there: what is fetched from it is keyed again by halves of the other bits, in the same
way, until a key is the whole fingerprint. So a probe meets at most HOT fingerprints under
one key, at any skew, and none is left out. Copies are one fingerprint from the start.

Defined results: null or empty texts have fingerprint zero and link like any other;
a null doc_id is returned, and is a component_id only where no other is reachable;
repeated rows share a component; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, tune
from .components import components

SHINGLE, DISTANCE, SEED, SEGMENTS, HOT = 3, 2, 42, 2, 64
#: Values that a ball holds at most; a larger one asks for more segments.
MOST_PROBES = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in more than half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    n, counts = len(stops), np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[at : at + 4096], stops[at : at + 4096], strict=False)), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            made = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return run


def radii(distance: int, parts: int) -> list[int]:
    """Radius of each part's ball (-1: the part needs no table), so that no two within the distance miss all of them."""
    return [distance // parts - (i > distance % parts) for i in range(parts)]


def ball(mask: int, radius: int) -> list[int]:
    """What to turn: all sets of at most radius bits of the mask, the empty one first."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    out = [sum(c) for r in range(min(radius, len(bits)) + 1) for c in combinations(bits, r)] if len(bits) ** radius < MOST_PROBES else []
    if not out:
        raise ValueError(f"a ball of radius {radius} in {len(bits)} bits is too large: take more segments")
    return out


def _cut_mask(mask: int, parts: int) -> list[int]:
    """The mask's bits in so many parts of like size, the highest bits first."""
    bits = [i for i in range(63, -1, -1) if mask >> i & 1]
    at = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _keys(rows: DataFrame, tables: list[tuple[int, int]], turned: bool, upwards: bool) -> DataFrame:
    """(key, part, fp) for each table (mask, radius): the fingerprint's value, or its ball's, under the key that the row has so far."""
    low = _long(1 << 63)  # turned, unsigned values compare as signed ones

    def keyed(part: int, mask: int, radius: int) -> Column:
        value = lambda m: F.col("fp").bitwiseXOR(m).bitwiseAND(_long(mask))
        masks = F.array(*map(_long, ball(mask, radius if turned else 0)))
        if upwards:
            masks = F.filter(masks, lambda m: value(m).bitwiseXOR(low) >= value(_long(0)).bitwiseXOR(low))
        return F.transform(masks, lambda m: F.struct(F.xxhash64("key", F.lit(part), value(m)).alias("key"), F.lit(part).alias("part")))

    made = [keyed(part, mask, radius) for part, (mask, radius) in enumerate(tables)]
    return rows.select(F.explode(F.concat(*made)).alias("k"), "fp").select("k.key", "k.part", "fp")


def _fetched(index: DataFrame, probes: DataFrame, tables: list[tuple[int, int]], free: int, distance: int, hot: int, upwards: bool) -> list[DataFrame]:
    """Verified pairs (a probes, b is in the index) whose keys agree so far and whose other bits (free) are yet to be compared."""
    own = settle(_keys(index, tables, False, False))
    crowded = own.groupBy("key").count().filter(F.col("count") > hot).select("key", F.lit(True).alias("hot"))
    listed = own.join(crowded, "key", "left_anti").select("key", "part", F.col("fp").alias("b"), F.lit(False).alias("hot")).union(crowded.select("key", F.lit(-1), F.lit(None).cast("long"), "hot"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance
    met = settle(_keys(probes, tables, True, upwards).drop("part").join(listed, "key").filter("hot or fp <> b").filter(F.col("hot") | close).select("key", "fp", "b", "hot"))
    out = [met.filter("not hot").select(F.col("fp").alias("a"), "b")]
    if not met.filter("hot").isEmpty():
        again = met.filter("hot").select("key", "fp")
        for part, (mask, _) in enumerate(tables):
            rest = free & ~mask
            held = own.filter(F.col("part") == part).join(crowded, "key", "left_semi").select("key", "fp")
            if rest and not held.isEmpty():
                halves = [rest] if bin(rest).count("1") <= 16 else _cut_mask(rest, 2)
                radius = [distance] if len(halves) == 1 else radii(distance, 2)
                out += _fetched(held, again, [(m, r) for m, r in zip(halves, radius, strict=True) if r >= 0], rest, distance, hot, False)
    return out


def links(fingerprints: DataFrame, max_distance: int = DISTANCE, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints (column fp) at max_distance or fewer differing bits, a pair once."""
    everything = (1 << 64) - 1
    tables = [(m, r) for m, r in zip(_cut_mask(everything, segments), radii(max_distance, segments), strict=True) if r >= 0]
    rows = fingerprints.select(F.lit(0).cast("long").alias("key"), "fp")
    found, *more = _fetched(rows, rows, tables, everything, max_distance, hot, True)
    for one in more:
        found = found.union(one)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = DISTANCE, seed: int = SEED, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fp (long), fingerprint (16 hex digits), component_id (smallest doc_id reachable
    over links), text_hash (64 bits, to tell rows of one doc_id apart) and root (the component's least fingerprint)."""
    tune(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    made = settle(base.mapInArrow(_fingerprints(shingle, seed), "doc_id long, text_hash long, fp long"))
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), max_distance, segments))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    label = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "root", "component_id")
    return made.join(label, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_hash", "root")
