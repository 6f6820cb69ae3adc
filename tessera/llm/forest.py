"""Approximate nearest neighbours with a hash-prefix forest.

A tree is a sorted array of long hash strings (the signs of BITS random projections).
A query descends in every tree with PROBES strings (its own, and those with its least
certain signs turned) to the longest prefix that each shares with any entry, and then
all trees ascend together, a level at a time, until the entries under the query's
prefixes are at least CANDIDATES (an entry counts once for each tree that holds it).
All entries under these prefixes are candidates, however many they are. Sketches (unit
vectors in 8 bits a component, and how far that is off) bound the cosine of each from
both sides; those that can be among the nearest by these bounds are compared by exact
cosine. So the answer is exact among the candidates.

Where sketches cannot tell the members of a dense group apart, a run names no pairs but
the blocks that hold them: entries are numbered by cells around sampled entries, so that
a group lies in few blocks of 2 ** BLOCK_BITS numbers. Query and block meet once, not in each
tree, all entries of the block are compared exactly, and the nearest of the block leave it.

The forest is one table for all vectors: (tree, hash string, entry, sketch), sorted by
range partitions and numbered, so that any place in any tree is found by its rank. Runs
of RUN ranks are what a task holds (more, where there would be over MOST_RUNS of them).
A first pass over the runs counts the entries of each level: a string counts what the run
at its rank holds, and SHARE at most, so that a crowded place does not end the ascent for
all trees. Both make a count less, never more, so the level chosen has no fewer candidates
than without. In a second pass a string goes to all runs that hold entries under its prefix
of that level, which are found by the first and the last string of each tree in each run.
What is shuffled are the rows of the trees, the strings of the queries, and the candidates
that the bounds leave of each run: no query visits what it does not share a prefix with.
Vectors that occur often are one entry (with its k + 1 least ids) and one query. In a dense
group of distinct vectors, that share their strings, each query meets the sketches of the
whole group in each tree, but a tree makes a row for each block of it only.

Effort and recall are set by TREES, PROBES and CANDIDATES, which do not depend on the
table. On vectors without any structure recall falls as the table grows, and these are to
be raised: the README gives measured figures.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and null ids, take no part (tiny and huge finite ones do: a vector is scaled
by a power of two, which changes no cosine); vectors of other lengths are not comparable
and never meet; rows that repeat an id and vector count once, an id with several vectors
by its nearest; ties go to the smaller id; an empty table gives an empty result; other
columns are not looked at."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, tune

TREES, BITS, PROBES, CANDIDATES, SEED = 64, 32, 32, 6000, 11
RUN, SHARE, TURNED, MOST_RUNS = 16384, 512, 16, 1 << 16
#: Rows of the sorted table that a partition should have at most about.
PART_ROWS = 1 << 19
#: Pairs that a task compares at once, and entries under one prefix from which they are taken as one block.
PAIRS, BLOCK = 1 << 21, 64
#: Numbers of a block (a power of two), entries to a cell, cells at most, and queries that meet a block in one task.
BLOCK_BITS, CELL, MOST_CELLS, ASKED = 12, 256, 1024, 1 << 14
#: Times the number to keep from which the pairs of a query in a tree of a run are given by their blocks.
CROWD = 4


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _scaled(batches: Iterator[pa.RecordBatch]):
    """Vectors that take part, scaled by a power of two to a largest component of 0.5 to 1."""
    for batch in batches:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = v.values
            if i is None or own is None or not len(own) or own.null_count:
                continue
            x = np.asarray(own, dtype=float)
            top = np.abs(x).max()
            if top > 0 and np.isfinite(top):
                ids.append(i)
                out.append(np.ldexp(x, -int(np.frexp(top)[1])) + 0.0)  # no negative zero
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in out], pa.int32()), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "dim", "v"])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v**2).sum(axis=1))[:, None]


def _laid(pivots: dict[int, np.ndarray]):
    """Vectors with the nearest of the pivots of their length, and a hash string around it: what is near has like keys."""

    def run(batches: Iterator[pa.RecordBatch]):
        known: dict[int, Hasher] = {}
        for batch in batches:
            dims = np.asarray(batch.column(0))
            cell, h = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                hasher = known.get(dim) or known.setdefault(dim, Hasher(dim, np.zeros(dim), 1))
                rows = np.flatnonzero(dims == dim)
                unit, about = _unit(_matrix(batch.column(1).take(pa.array(rows)))), pivots.get(dim, np.zeros((1, dim)))
                cell[rows] = (unit.astype(np.float32) @ about.T.astype(np.float32)).argmax(axis=1)
                h[rows] = hasher.strings(hasher.project(unit - about[cell[rows]]))[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(h)], ["dim", "v", "ids", "cell", "h"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]):
    """Sums of the unit vectors of a part, by length and place."""
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        dims = np.asarray(batch.column(0))
        for dim in np.unique(dims).tolist():
            v = _matrix(batch.column(1).filter(pa.array(dims == dim)))
            n, s = held.get(dim, (0, 0.0))
            held[dim] = n + len(v), s + _unit(v).sum(axis=0)
    for dim, (n, s) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(s, pa.float64()), pa.array([n] * dim, pa.int64())], ["dim", "at", "s", "n"])


class Hasher:
    """Hash strings and sketches of the vectors of one length."""

    def __init__(self, dim: int, centre: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        rng = np.random.default_rng((seed, dim))
        self.planes = rng.standard_normal((dim, trees * bits)).astype(np.float32)
        self.centre, self.trees, self.bits = centre, trees, bits
        self.place = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)

    def project(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.centre).astype(np.float32) @ self.planes

    def strings(self, projected: np.ndarray) -> np.ndarray:
        """The string of each vector in each tree."""
        signs = (projected > 0).reshape(len(projected), self.trees, self.bits)
        return (signs * self.place).sum(axis=2, dtype=np.uint64).view(np.int64)

    def turned(self, projected: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
        """For one projected vector and each tree: the likeliest strings as (bits to turn, first level that holds all of them)."""
        out = []
        for own in projected.reshape(self.trees, self.bits)[:, : min(TURNED, self.bits)]:
            out.append([(sum(1 << (self.bits - 1 - b) for b in s), max(s, default=-1) + 1) for s in likeliest(own.astype(float) ** 2, probes)])
        return out


def sketches(unit: np.ndarray) -> list[bytes]:
    """Each unit vector as a scale and the length of what the sketch is off by (4 bytes each), and a signed byte for each component."""
    scale = (np.abs(unit).max(axis=1) / 127).astype("<f4")
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    off = np.sqrt(((unit - small * scale[:, None].astype(float)) ** 2).sum(axis=1))
    head = np.stack((scale, off.astype("<f4")), axis=1)
    return [a.tobytes() + b.tobytes() for a, b in zip(head, small, strict=True)]


def _sketched(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of sketches of one length, and what they are off by."""
    raw = np.frombuffer(column.buffers()[2], np.uint8)[: len(column) * len(column[0].as_py())].reshape(len(column), -1)
    head = np.ascontiguousarray(raw[:, :8]).view("<f4")
    return raw[:, 8:].view(np.int8).astype(np.float32) * head[:, :1], head[:, 1]


def likeliest(cost: np.ndarray, n: int) -> list[tuple[int, ...]]:
    """The n subsets of places with the least sums of cost, the empty one first; a subset comes before those that hold it."""
    order = np.argsort(cost, kind="stable")
    c = cost[order].tolist()
    out: list[tuple[int, ...]] = [()]
    heap = [(c[0], (0,))]
    while len(out) < n and heap:
        s, a = heapq.heappop(heap)
        out.append(tuple(order[list(a)].tolist()))
        if (last := a[-1]) + 1 < len(c):
            heapq.heappush(heap, (s + c[last + 1], (*a, last + 1)))
            heapq.heappush(heap, (s - c[last] + c[last + 1], (*a[:-1], last + 1)))
    return out


def _hashed(centres, probes: int, query: bool, trees: int, bits: int):
    """Rows of the trees: one for each vector and tree, or for each query, tree and string."""
    names = ["dim", "tree", "h", "kind", "id", "from", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]):
        known: dict[int, Hasher] = {}
        for batch in batches:
            ids, dims = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for dim in np.unique(dims).tolist():
                hasher = known.get(dim) or known.setdefault(dim, Hasher(dim, np.array(centres[dim]), trees, bits))
                rows = np.flatnonzero(dims == dim)
                for at in range(0, len(rows), 128 if query else 512):
                    some = rows[at : at + (128 if query else 512)]
                    unit = _unit(_matrix(batch.column(2).take(pa.array(some))))
                    projected = hasher.project(unit)
                    own = hasher.strings(projected)
                    if query:
                        turned = [hasher.turned(p, probes) for p in projected]
                        per = [len(t) for one in turned for t in one]
                        h = np.repeat(own.ravel(), per) ^ np.array([x for one in turned for t in one for x, _ in t], np.int64)
                        start = np.array([x for one in turned for t in one for _, x in t], np.int32)
                    else:
                        per, h, start = [1] * own.size, own.ravel(), np.zeros(own.size, np.int32)
                    tree = np.repeat(np.tile(np.arange(trees, dtype=np.int32), len(some)), per)
                    which = np.repeat(np.repeat(np.arange(len(some)), trees), per)
                    kept = pa.array(sketches(unit), pa.binary()).take(pa.array(which))
                    n = len(h)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(tree), pa.array(h), pa.array(np.full(n, int(query), np.int32)), pa.array(ids[some][which]), pa.array(start), kept], names)

    return run


_ROW = "dim int, tree int, h long, kind int, id long, from int, sketch binary"


def _numbered(batches: Iterator[pa.RecordBatch]):
    """A sorted partition's rows with the partition's number and the entries that stand before each."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        entry = np.asarray(batch.column(batch.schema.get_field_index("kind"))) == 0
        before = seen + np.cumsum(entry) - entry
        seen += int(entry.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(entry), part, np.int32)), pa.array(before.astype(np.int64))], [*batch.schema.names, "part", "before"])


def _segments(table: pa.Table):
    """For each tree of a run: entries sorted by string, and the query strings."""
    col = {n: table.column(n).combine_chunks() for n in table.column_names}
    dim, tree, h, kind = (np.asarray(col[n]) for n in ("dim", "tree", "h", "kind"))
    order = np.lexsort((np.asarray(col["id"]), h, kind, tree, dim))
    key = np.stack((dim[order], tree[order]))
    cuts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]))) if len(order) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = order[a:b]
        entries, strings = part[kind[part] == 0], part[kind[part] == 1]
        if len(entries) and len(strings):
            yield col, h[entries], entries, strings, h[strings]


def _bounds(own: np.ndarray, strings: np.ndarray, level, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the sorted entries under the strings' prefixes of a level."""
    low, high = _prefix(strings, level, bits)
    return np.searchsorted(own, low), np.searchsorted(own, high, side="right")


def _prefix(strings: np.ndarray, level, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest string that share the strings' prefixes of a level."""
    rest = np.left_shift(np.int64(1), np.int64(bits) - level)
    low = strings & -rest
    return low, low + rest - 1


def _counts(bits: int):
    """For each query of a run, the entries at each level, SHARE of a string at most."""

    def run(table: pa.Table) -> pa.Table:
        total: dict[int, np.ndarray] = {}
        for col, own, _, rows, strings in _segments(table):
            start, query = np.asarray(col["from"])[rows], np.asarray(col["id"])[rows]
            which, place = np.unique(query, return_inverse=True)
            got = np.zeros((len(which), bits + 1), np.int64)
            for level in range(bits + 1):
                live = np.flatnonzero(start <= level)
                low, high = _bounds(own, strings[live], np.int64(level), bits)
                got[:, level] = np.bincount(place[live], np.minimum(high - low, SHARE), len(which))
            for q, n in zip(which.tolist(), got, strict=True):
                total[q] = total.get(q, 0) + n
        met = [pa.array([int(n[level]) for n in total.values()], pa.int64()) for level in range(bits + 1)]
        return pa.Table.from_arrays([pa.array(list(total), pa.int64()), *met], names=["id", *(f"c{i}" for i in range(bits + 1))])

    return run


def _spread(spots: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int):
    """Each string once for each run that holds entries under its prefix of its level."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            dim, tree, h, level = (np.asarray(batch.column(batch.schema.get_field_index(n))) for n in ("dim", "tree", "h", "level"))
            low, high = _prefix(h, level.astype(np.int64), bits)
            which, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d, t in np.unique(np.stack((dim, tree)), axis=1).T.tolist() if len(h) else []:
                if (d, t) in spots:
                    rows = np.flatnonzero((dim == d) & (tree == t))
                    held, first, last = spots[d, t]
                    a = np.searchsorted(last, low[rows])
                    n = np.maximum(np.searchsorted(first, high[rows], side="right") - a, 0)
                    which.append(np.repeat(rows, n))
                    runs.append(held[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            out = batch.take(pa.array(np.concatenate(which)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(runs))], [*out.schema.names, "run"])

    return run


def _best(query: np.ndarray, near: np.ndarray, off: np.ndarray, keep: int) -> np.ndarray:
    """Which of the pairs, sorted by query, can be among the keep nearest of their query."""
    out = np.ones(len(query), bool)
    cuts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1], [True])))
    low, high = near - off, near + off
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > keep:
            out[a:b] = high[a:b] >= np.partition(low[a:b], b - a - keep)[b - a - keep]
    return out


def _crowded(query: np.ndarray, entry: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs are better given by their blocks, and these (query, block): all pairs of a query, if they are many and in at most half as many blocks."""
    blocks = np.unique(np.stack((query, entry >> BLOCK_BITS)), axis=1)
    who, pairs = np.unique(query, return_counts=True)
    held = np.unique(blocks[0], return_counts=True)[1]
    many = (pairs > CROWD * keep) & (2 * held <= pairs)
    return many[np.searchsorted(who, query)], blocks[:, many[np.searchsorted(who, blocks[0])]]


def _candidates(bits: int, keep: int | None):
    """(query, entry, cosine of their sketches, what it is off by at most, False) for the entries of a run under the query's prefixes of its level;
    with keep, those that can be among the keep nearest of these, or (query, block, null, null, True) for blocks that hold them."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32))]
        whole: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        for col, own, entries, rows, strings in _segments(table):
            ids = np.asarray(col["id"])
            low, high = _bounds(own, strings, np.asarray(col["level"])[rows].astype(np.int64), bits)
            met = np.flatnonzero(high > low)
            met = met[np.argsort(ids[rows[met]], kind="stable")]
            if not len(met):
                continue
            rows, low, n = rows[met], low[met], (high - low)[met]
            held, held_off = _sketched(col["sketch"].take(pa.array(entries)))
            first = np.unique(ids[rows], return_index=True)[1]
            block = np.cumsum(np.add.reduceat(n, first)) // PAIRS  # whole queries
            cuts = [*first[np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))].tolist(), len(rows)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                asked, asked_off = _sketched(col["sketch"].take(pa.array(rows[a:b])))
                some = n[a:b]
                ends = np.cumsum(some)
                entry, place = np.repeat(low[a:b] - (ends - some), some) + np.arange(ends[-1]), np.repeat(np.arange(b - a), some)
                near = np.empty(len(entry), np.float32)
                for i in np.flatnonzero(some >= BLOCK).tolist():
                    near[ends[i] - some[i] : ends[i]] = held[low[a + i] : low[a + i] + some[i]] @ asked[i]
                few = np.flatnonzero(some[place] < BLOCK)
                for i in range(0, len(few), 8192):
                    at = few[i : i + 8192]
                    near[at] = np.einsum("ij,ij->i", held[entry[at]], asked[place[at]])
                off = asked_off[place] + held_off[entry] * (1 + asked_off[place]) + np.float32(1e-6 + 1.2e-7 * held.shape[1])  # and float arithmetic
                query = ids[rows[a:b]][place]
                kept = _best(query, near, off, keep) if keep else slice(None)
                found = query[kept], ids[entries[entry[kept]]], near[kept], off[kept]
                if keep:
                    many, blocks = _crowded(*found[:2], keep)
                    whole.append(blocks)
                    found = tuple(x[~many] for x in found)
                out.append(found)
        blocks = np.unique(np.concatenate(whole, axis=1), axis=1)
        q, e, d, o = (np.concatenate(x) for x in zip(*out, strict=True))
        n, m = len(q), blocks.shape[1]
        bound = lambda x: pa.concat_arrays([pa.array(x, pa.float32()), pa.nulls(m, pa.float32())])
        return pa.Table.from_arrays([pa.array(np.concatenate((q, blocks[0]))), pa.array(np.concatenate((e, blocks[1]))), bound(d), bound(o), pa.array(np.arange(n + m) >= n)], names=["q", "e", "near", "off", "whole"])

    return run


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, summed in the order of the components as SQL's are."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _compared(keep: int):
    """(query, entry, cosine, what it is off by as a float): the keep nearest entries of a block for each of its queries, ties to the smaller first id."""

    def run(table: pa.Table) -> pa.Table:
        col = {n: table.column(n).combine_chunks() for n in table.column_names}
        dim, kind, ids, first = (np.asarray(col[n]) for n in ("dim", "kind", "id", "first"))
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for d in np.unique(dim).tolist():
            entries, asked = np.flatnonzero((dim == d) & (kind == 0)), np.flatnonzero((dim == d) & (kind == 1))
            if not len(entries) or not len(asked):
                continue
            held = _matrix(col["v"].take(pa.array(entries)))
            unit, step = _unit(held).T, max(1, PAIRS // len(entries))
            for at in range(0, len(asked), step):
                rows = asked[at : at + step]
                query = _matrix(col["v"].take(pa.array(rows)))
                near = _unit(query) @ unit
                last = max(0, len(entries) - keep)
                i, j = np.nonzero(near >= np.partition(near, last, axis=1)[:, last : last + 1] - 1e-12)  # more than sums in another order differ by
                score = np.concatenate([_cosines(query[i[x : x + 65536]], held[j[x : x + 65536]]) for x in range(0, len(i), 65536)])
                order = np.lexsort((ids[entries[j]], first[entries[j]], -score, i))
                order = order[np.arange(len(i)) - np.searchsorted(i, i) < keep]  # i is sorted, before and after
                out.append((ids[rows[i[order]]], ids[entries[j[order]]], score[order]))
        q, e, c = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(q), pa.array(e), pa.array(c.astype(np.float32)), pa.array(np.full(len(q), 1e-6, np.float32))], names=["q", "e", "near", "off"])

    return run


def _usable(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(_scaled, "vec_id long, dim int, v array<double>").dropDuplicates(["vec_id", "dim", "v"])


def candidates(entries: DataFrame, asked: DataFrame, trees: int = TREES, bits: int = BITS, probes: int = PROBES, least: int = CANDIDATES, keep: int | None = None) -> DataFrame:
    """(q, e, near, off): the entries (id, dim, v) that the queries (id, dim, v) meet in the forest, with the cosine of their sketches
    and what it is off by at most; with keep, at least those that can be among the keep nearest (ties to the smaller first, which
    entries then have), and others of their blocks."""
    spark = tune(entries.sparkSession)
    n, m = entries.count(), asked.count()
    means = entries.select("dim", "v").mapInArrow(_sums, "dim int, at int, s double, n long").groupBy("dim", "at").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("s")).orderBy("dim", "at").collect()  # one number for each component
    centres: dict[int, list[float]] = {}
    for r in means:
        centres.setdefault(r.dim, []).append(r.s)
    known = asked.filter(F.col("dim").isin(*centres)) if centres else asked.limit(0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(trees * (n + m * probes) / PART_ROWS))
    dealt = lambda df: df.select("id", "dim", "v").repartition(parts, "id")  # noqa: E731 - a few vectors make many rows
    rows = dealt(entries).mapInArrow(_hashed(centres, 1, False, trees, bits), _ROW).union(dealt(known).mapInArrow(_hashed(centres, probes, True, trees, bits), _ROW))
    order = ["dim", "tree", "h", "kind", "id"]
    placed = settle(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_numbered, _ROW + ", part int, before long"))
    ends, at = [], 0
    for r in placed.groupBy("part").agg(F.sum(1 - F.col("kind")).alias("n")).orderBy("part").collect():  # one number for each partition
        ends.append((r.part, at))
        at += r.n
    placed = placed.join(F.broadcast(spark.createDataFrame(ends, "part int, offset long")), "part").withColumn("rank", F.col("before") + F.col("offset")).drop("part", "before", "offset")
    size = max(RUN, math.ceil(at / MOST_RUNS))
    placed = placed.withColumn("run", F.floor(F.col("rank") / size)).drop("rank")
    salts = max(1, math.ceil(trees * m * probes / (16 * max(at, size))))  # many more queries than entries: a run is dealt to several tasks
    held = placed.filter("kind = 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    strings = placed.filter("kind = 1").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    levels = [f"c{i}" for i in range(bits + 1)]
    counted = held.unionByName(strings).drop("sketch").groupBy("run", "salt").applyInArrow(_counts(bits), "id long, " + ", ".join(f"{c} long" for c in levels)).groupBy("id").agg(*[F.sum(c).alias(c) for c in levels])
    level = F.coalesce(*[F.when(F.col(f"c{i}") >= least, F.lit(i)) for i in range(bits, -1, -1)], F.lit(0)).alias("level")
    chosen = settle(counted.select("id", level))
    spots: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for r in placed.filter("kind = 0").groupBy("dim", "tree", "run").agg(F.min("h").alias("first"), F.max("h").alias("last")).orderBy("dim", "tree", "run").collect():  # a row for each run, and one more for each tree
        spots.setdefault((r.dim, r.tree), []).append((r.run, r.first, r.last))
    found = {k: tuple(np.array(x, np.int64).T) for k, x in spots.items()}
    live = strings.drop("run").join(chosen, "id", "left").withColumn("level", F.coalesce("level", F.lit(0))).filter(F.col("from") <= F.col("level")).select("dim", "tree", "h", "kind", "id", "from", "sketch", "salt", "level")
    sent = live.mapInArrow(_spread(found, bits), _ROW + ", salt int, level int, run long")
    both = held.withColumn("level", F.lit(0)).unionByName(sent)
    made = both.groupBy("run", "salt").applyInArrow(_candidates(bits, keep), "q long, e long, near float, off float, whole boolean")
    met = made.groupBy("whole", "q", "e").agg(F.max("near").alias("near"), F.max("off").alias("off"))
    if not keep:
        return met.drop("whole")
    met = settle(met)
    pairs = met.filter("not whole").drop("whole")
    crowds = met.filter("whole").select(F.col("e").alias("block"), "q")
    if crowds.isEmpty():
        return pairs
    dealt = crowds.groupBy("block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("salts"))
    columns = ["block", "salt", "kind", "dim", "id", "first", "v"]
    blocks = entries.withColumn("block", F.shiftright("id", BLOCK_BITS)).join(dealt, "block").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).withColumn("kind", F.lit(0)).select(*columns)
    comers = crowds.join(dealt, "block").withColumn("salt", F.pmod(F.xxhash64("q"), F.col("salts")).cast("int")).join(asked.select(F.col("id").alias("q"), "dim", "v"), "q")
    comers = comers.withColumn("kind", F.lit(1)).withColumn("first", F.lit(0).cast("long")).withColumnRenamed("q", "id").select(*columns)
    exact = blocks.union(comers).groupBy("block", "salt").applyInArrow(_compared(keep), "q long, e long, near float, off float")
    return pairs.union(exact).groupBy("q", "e").agg(F.min_by("near", "off").alias("near"), F.min("off").alias("off"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, probes: int = PROBES, least: int = CANDIDATES, bits: int = BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query among vectors (both: vec_id, embedding), without the query's own id."""
    tune(vectors.sparkSession)
    numbered = F.monotonically_increasing_id().alias("id")
    first = Window.partitionBy("dim", "v").orderBy("vec_id")
    few = _usable(vectors).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    told = settle(few.groupBy("dim", "v").agg(F.collect_list("vec_id").alias("ids")))  # k + 1 ids at most
    n = told.count()
    share = min(1.0, min(MOST_CELLS, n / CELL) / max(1, n))
    pivots: dict[int, list[list[float]]] = {}
    for r in told.filter(F.pmod(F.xxhash64("dim", "v"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).select("dim", "v").limit(2 * MOST_CELLS).collect():
        pivots.setdefault(r.dim, []).append(r.v)
    laid = told.mapInArrow(_laid({dim: _unit(np.array(v)) for dim, v in pivots.items()}), "dim int, v array<double>, ids array<long>, cell int, h long")
    parts, order = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / PART_ROWS)), ["dim", "cell", "h", F.xxhash64("v")]
    entries = settle(laid.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(numbered, "dim", "v", "ids", F.array_min("ids").alias("first")))
    usable = settle(_usable(queries))
    asked = settle(usable.select("dim", "v").distinct().select(numbered, "dim", "v"))
    often = entries.select("dim", F.explode("ids").alias("vec_id")).groupBy("dim", "vec_id").count().agg(F.max("count")).first()[0] or 1
    keep = k * often + 1  # so many entries hold k + 1 ids at least, the query's own among them
    enough = max(least, trees * (k + 1)) * often  # an entry counts once for each tree
    found = candidates(entries.select("id", "dim", "v", "first"), asked, trees, bits, probes, enough, keep)
    low, high = F.col("near") - F.col("off"), F.col("near") + F.col("off")
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(low), "e")))
    short = ranked.withColumn("least", F.max(F.when(F.col("n") == keep, low)).over(Window.partitionBy("q"))).filter(F.col("least").isNull() | (high >= F.col("least"))).select("q", "e")
    met = short.join(entries.withColumnRenamed("id", "e"), "e").select("q", F.col("v").alias("w"), "ids").join(asked.withColumnRenamed("id", "q"), "q")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = met.select("q", dot("v", "w").alias("d"), dot("v", "v").alias("vv"), dot("w", "w").alias("ww"), F.explode("ids").alias("vec_id")).select("q", "vec_id", (F.col("d") / (F.sqrt("vv") * F.sqrt("ww"))).alias("score"))
    order = [F.desc("score"), F.col("vec_id")]
    top = scored.groupBy("q", "vec_id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("n") <= k + 1).drop("n")
    own = usable.select(F.col("vec_id").alias("query_id"), "dim", "v").join(asked.withColumnRenamed("id", "q"), ["dim", "v"]).select("query_id", "q")
    answers = own.join(settle(top), "q").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
