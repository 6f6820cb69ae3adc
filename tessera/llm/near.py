"""Near-dedup by real similarity: five-word shingles, a Jaccard index of 0.8 or more.

MinHash bands find the candidates: with BANDS bands of ROWS minima, a pair at 0.8 shares
no band with a probability of 3e-6, and a more similar pair with less. Candidates are verified on the complete
shingle sets. First each text meets the least of its band; then, where a band still has texts
of different components, these are compared with each other, so that no verified pair is lost
to the order of texts: by sketches of SKETCH bits (the lowest bits of as many minima, of which
a pair at 0.8 shares fewer than is asked for with a probability of 3e-6), and what passes on
the sets, each pair in the first band that it shares. Both happen inside the tasks that hold a
band, where no row is made of a pair: the first pass leaves the texts of a band that have a pair
to verify, the second verifies, and gives the pairs that join components, fewer than texts. A
band of more than TILE texts or WEIGHT shingles is cut in blocks, and each two blocks meet in a
task of their own. Links of the SimHash operator (op2) count as well.

Defined results: a text of fewer words than a shingle is one shingle; null and empty texts
have none and link by their fingerprint only; repeated rows share a component; an empty
table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import settle, tune
from .components import components
from .simhash import simhash_groups

SHINGLE, SIMILARITY, BANDS, ROWS, SKETCH, ERRORS = 5, 0.8, 32, 5, 2048, 4.5
#: Texts and shingles of a block of a band; texts (first pass) and shingles (second pass) that a group of bands should have at most about.
TILE, WEIGHT, TEXTS, GRAMS = 4096, 1 << 21, 1 << 13, 1 << 22
_ODD = np.random.default_rng(20240608).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def _shingles(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each part of a text column: hashes of the shingles row by row, and the bounds of the rows."""
    for _, part in T.slices(column):
        buf, bounds = T.raw(part)
        buf = _LOWER[buf]
        starts, ends, rows = T.word_bounds(T.is_word_byte(buf), bounds)
        words = T.word_hashes(buf, starts, ends)
        cut = np.searchsorted(rows, np.arange(len(bounds)))
        n = np.diff(cut)
        made = np.where(n > 0, np.maximum(1, n - SHINGLE + 1), 0)
        out = np.concatenate(([0], np.cumsum(made)))
        at = np.repeat(cut[:-1] - out[:-1], made) + np.arange(out[-1])
        yield T.sequence_hashes(words, at, np.minimum(at + SHINGLE, np.repeat(cut[1:], made)) - at), out


def _band_keys(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BANDS keys for each row that has shingles."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    keys = np.empty((len(starts), BANDS), np.uint64)
    if not len(starts):
        return keys
    for band in range(BANDS):
        key = np.full(len(starts), band, np.uint64)
        for odd in _ODD[band * ROWS : (band + 1) * ROWS]:
            least = np.minimum.reduceat(((grams * odd) >> np.uint64(32)).astype(np.uint32), starts)
            key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        keys[:, band] = key
    return keys


def _keys(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        at = 0
        for grams, bounds in _shingles(batch.column(1)):
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            keys = _band_keys(grams, bounds)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).reshape(-1)))
            sizes = [len(np.unique(grams[a:b])) for a, b in zip(bounds[full], bounds[full + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + full)), pa.array(sizes, pa.int64()), lists], ["h", "n", "keys"])
            at += len(n)


def _sets(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        at = 0
        for grams, bounds in _shingles(batch.column(1)):
            made = [np.unique(grams[a:b]).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(made)), pa.array(made, pa.list_(pa.int64()))], ["h", "grams"])
            at += len(made)


def _sketches(batches: Iterator[pa.RecordBatch]):
    """SKETCH bits of each set, as longs: two sets share a bit with a probability of (1 + J) / 2."""
    odd = np.random.default_rng(20240609).integers(1, 2**63, SKETCH, dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        rows = []
        for own in batch.column(1):
            grams = np.asarray(own.values, dtype=np.int64).view(np.uint64)
            least = np.full(SKETCH, 2**64 - 1, np.uint64)
            for at in range(0, len(grams), 512):
                np.minimum(least, T.mix(grams[at : at + 512, None] * odd).min(axis=0), out=least)
            rows.append(np.packbits((least & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["h", "sketch"])


def _compared(table: pa.Table, similarity: float, most: int, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A row, and the rows of the same band (in two blocks: of the other) that are to be verified with it here: of another
    label, of a size and a sketch that allow it, and in no band before this. The label may change meanwhile."""
    key, lo, hi, block, n = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "n"))
    lists = lambda c: np.asarray(table.column(c).combine_chunks().flatten()).reshape(len(key), -1)
    sketch, keys = lists("sketch").view(np.uint64), lists("keys")
    order = np.lexsort((block, hi, lo, key))
    place = np.stack((key, lo, hi))[:, order]
    cuts = np.flatnonzero(np.concatenate(([True], (place[:, 1:] != place[:, :-1]).any(axis=0), [True]))) if len(order) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]
        two = lo[rows[0]] != hi[rows[0]]
        second = rows[block[rows] == hi[rows[0]]]
        for k, i in enumerate(rows[: b - a - len(second)] if two else rows[:-1]):
            js = second if two else rows[k + 1 :]
            js = js[(label[js] != label[i]) & (np.minimum(n[js], n[i]) >= similarity * np.maximum(n[js], n[i]) - 1e-9)]
            js = js[np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= most]
            js = js[keys[i, (keys[js] == keys[i]).argmax(axis=1)] == key[i]]
            if len(js):
                yield i, js


def _open(similarity: float, most: int):
    """The rows that have others to be verified with."""

    def run(table: pa.Table) -> pa.Table:
        kept = np.zeros(len(table), bool)
        for i, js in _compared(table, similarity, most, table.column("root").to_numpy()):
            kept[i] = kept[js] = True
        return table.filter(pa.array(kept)).drop_columns(["part"])

    return run


def _joined(similarity: float, most: int):
    """(a, b): pairs of similar sets, as many as join the components that similar pairs of these rows join."""

    def run(table: pa.Table) -> pa.Table:
        grams = table.column("grams").combine_chunks()
        at, flat = np.asarray(grams.offsets), np.asarray(grams.values).view(np.uint64)
        h, label = table.column("h").to_numpy(), table.column("root").to_numpy().copy()
        out: list[tuple[int, int]] = []
        for i, js in _compared(table, similarity, most, label):
            own, n = flat[at[i] : at[i + 1]], at[js + 1] - at[js]
            ends = np.cumsum(n)
            theirs = flat[np.repeat(at[js] - (ends - n), n) + np.arange(ends[-1])]
            met = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            shared = np.add.reduceat(met.astype(np.int64), ends - n)
            for j in js[shared >= similarity * (len(own) + n - shared) - 1e-9].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out.append((h[i], h[j]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _cross(left: DataFrame, marks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of similar texts of a band (key, h, n, root) that join all roots which similar texts of the bands have."""
    share = (1 - similarity) / 2
    most = math.ceil(SKETCH * share + ERRORS * math.sqrt(SKETCH * share * (1 - share)))
    spread = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_parts = lambda df, n: df.withColumn("part", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(max(spread, math.ceil(n))))).groupBy("part")
    blocks = left.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / WEIGHT)).alias("blocks")).filter("blocks > 1")
    dealt = left.join(blocks, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("key", "h", "n", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    schema = "key long, h long, n long, root long, block long, lo long, hi long, keys array<long>, sketch array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    whole = dealt.join(marks, "h").select(*names)
    few = settle(in_parts(whole, left.count() / TEXTS).applyInArrow(_open(similarity, most), schema))
    weight = few.agg(F.sum("n")).first()[0] or 0
    return in_parts(few.join(sets, "h").select(*names, "grams"), weight / GRAMS).applyInArrow(_joined(similarity, most), "a long, b long")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    one, two = sets.select(F.col("h").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("h").alias("b"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    both = pairs.join(one, "a").join(two, "b")
    return both.filter(shared >= similarity * (F.size("ga") + F.size("gb") - shared) - 1e-9).select("a", "b")


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash (64 bits, to tell rows of one doc_id apart) and root: rows whose texts are linked share it."""
    tune(docs.sparkSession)
    text = docs.select(F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    groups = settle(simhash_groups(docs).select("doc_id", "text_hash", F.col("root").alias("fp_root")))
    least = groups.groupBy("fp_root").agg(F.min("text_hash").alias("b"))
    by_print = groups.join(least, "fp_root").select(F.col("text_hash").alias("a"), "b").filter("a <> b").distinct()
    banded = settle(text.mapInArrow(_keys, "h long, n long, keys array<long>"))
    entries = banded.select("h", "n", F.explode("keys").alias("key"))
    met = entries.groupBy("key").agg(F.min(F.struct("h", "n")).alias("first"), F.max("h").alias("last")).filter("first.h <> last").drop("last")
    held = settle(entries.join(met, "key").distinct())
    # equal texts give equal sets: one row of each
    sets = settle(text.join(held.select("h").distinct(), "h", "left_semi").mapInArrow(_sets, "h long, grams array<long>").dropDuplicates(["h"]))
    sized = lambda x, y: F.least(x, y) >= F.lit(similarity) * F.greatest(x, y) - 1e-9
    star = held.filter(F.col("h") != F.col("first.h")).filter(sized(F.col("n"), F.col("first.n")))
    links = settle(by_print.union(_alike(star.select(F.col("h").alias("a"), F.col("first.h").alias("b")).distinct(), sets, similarity)))
    roots = components(links)
    rooted = held.select("key", "h", "n").join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
    left = settle(rooted.join(open_, "key"))
    some = left.select("h").distinct()
    sketched = sets.join(some, "h", "left_semi").mapInArrow(_sketches, "h long, sketch array<long>")
    marks = sketched.join(banded.join(some, "h", "left_semi").select("h", "keys").dropDuplicates(["h"]), "h")
    found = components(links.union(_cross(left, marks, sets, similarity)))
    return groups.join(found.withColumnRenamed("node", "text_hash"), "text_hash", "left").select("doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root"))
