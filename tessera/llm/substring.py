"""Substring dedup by seed and extend.

Every window of ``window`` consecutive words has a seed: the least hash of its
``gram``-word grams (winnowing). Runs of windows with one seed form a block: the
seed extended to both sides as far as its windows reach. Equal windows have equal
seeds, so documents meet on seeds alone. A seed found once is dropped. Where a
block is repeated whole, all of its windows are; only blocks of one seed with
different words are compared window by window, one document for each block.
Removed windows that touch or overlap make the maximal repeats.

Sequences count as equal if 64-bit hashes of their words agree, and only sequences of
one seed (itself a hash of 64 bits) are ever compared, so that at 10**13 blocks chance
makes fewer than one error; no structure of the texts makes hashes meet (textnum.py).

No group is gathered: seeds are counted with map-side sums, the joins on seeds are
split where skewed, and a document's own lists are bounded by its length (rows of one
doc_id, or of none, are told apart by SALTS remainders of a hash of their text).

Defined results: a null text has no words; a null doc_id counts as the smallest;
rows that share a doc_id are judged one by one, against smaller doc_ids and their
own earlier windows; an empty table gives an empty result; other columns are not
looked at."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import key_of, settle, tune

WINDOW, GRAM, SALTS = 20, 8, 1 << 15


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, bounds of rows, row of each word and hash of each word, for the parts of a batch."""
    text = batch.column(batch.schema.get_field_index("text"))
    for at, part in T.slices(text):
        buf, bounds = T.raw(part)
        starts, ends, rows = T.word_bounds(T.is_word_byte(buf), bounds)
        yield at, bounds, rows, T.word_hashes(buf, starts, ends)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _distinct(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of one of each (group, value)."""
    order = np.lexsort((value, group))
    new = np.ones(len(order), bool)
    new[1:] = (value[order[1:]] != value[order[:-1]]) | (group[order[1:]] != group[order[:-1]])
    return order[new]


def _seeds(window: int, gram: int):
    def run(batches):
        for batch in batches:
            key, salt = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("k", "s"))
            for at, _, rows, words in _parts(batch):
                first, _, seed, block = T.winnow(words, rows, window, gram)
                if len(first):
                    row = rows[first]
                    one = _distinct(row, block)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(seed[one])), pa.array(_signed(block[one])), pa.array(key[at + row[one]]), pa.array(salt[at + row[one]])], ["h", "c", "k", "s"])

    return run


def _windows(window: int, gram: int):
    """Window hashes of the listed blocks."""

    def run(batches):
        for batch in batches:
            key, salt = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("k", "s"))
            blocks = batch.column(batch.schema.get_field_index("blocks"))
            for at, _, rows, words in _parts(batch):
                first, last, seed, block = T.winnow(words, rows, window, gram)
                hashes = T.rolling_hashes(words, window)
                row = rows[first]
                cut = np.searchsorted(row, np.arange(rows[-1] + 2 if len(rows) else 1))
                out = []
                for r in range(len(cut) - 1):
                    listed = blocks[at + r]
                    if listed.is_valid and cut[r + 1] > cut[r]:
                        wanted = np.array(listed.as_py(), np.int64)
                        for j in np.flatnonzero(np.isin(_signed(block[cut[r] : cut[r + 1]]), wanted)) + cut[r]:
                            w = hashes[first[j] : last[j] + 1]
                            out.append((np.full(len(w), seed[j]), w, np.full(len(w), at + r)))
                if out:
                    h, w, row = (np.concatenate(x) for x in zip(*out, strict=True))
                    one = _distinct(row, w)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(h[one])), pa.array(_signed(w[one])), pa.array(key[row[one]]), pa.array(salt[row[one]])], ["h", "w", "k", "s"])

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept_text string"


def _cut(window: int, gram: int, with_text: bool):
    """Removes the words of repeated windows."""

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            text = col["text"]
            for at, bounds, rows, words in _parts(batch):
                first, last, _, block = T.winnow(words, rows, window, gram)
                hashes = T.rolling_hashes(words, window)
                rowcut, wordcut = (np.searchsorted(x, np.arange(len(bounds))) for x in (rows[first], rows))
                out = []
                for r in range(len(bounds) - 1):
                    a, b = int(wordcut[r]), int(wordcut[r + 1])
                    value = text[at + r].as_py()
                    own = (value or "").encode().split()
                    spans = []
                    n = b - a - window + 1
                    if n > 0:
                        h = _signed(hashes[a : a + n])
                        order = np.argsort(h, kind="stable")
                        gone = np.zeros(n, bool)
                        gone[order[1:]] = h[order[1:]] == h[order[:-1]]
                        if (listed := col["blocks"][at + r]).is_valid and len(listed):
                            j = np.flatnonzero(np.isin(_signed(block[rowcut[r] : rowcut[r + 1]]), np.array(listed.as_py(), np.int64))) + rowcut[r]
                            for x, y in zip(first[j] - a, last[j] - a, strict=True):
                                gone[x : y + 1] = True
                        if (listed := col["windows"][at + r]).is_valid and len(listed):
                            gone |= np.isin(h, np.array(listed.as_py(), np.int64))
                        if gone.any():
                            step = np.zeros(b - a + 1, np.int64)
                            np.add.at(step, np.flatnonzero(gone), 1)
                            np.add.at(step, np.flatnonzero(gone) + window, -1)
                            covered = np.cumsum(step[:-1]) > 0
                            edge = np.diff(np.concatenate(([0], covered.view(np.int8), [0])))
                            spans = [{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                            own = list(compress(own, ~covered))
                    kept = b" ".join(own)
                    out.append((col["doc_id"][at + r].as_py(), b - a, b - a - len(own), hashlib.sha256(kept).hexdigest(), spans, kept.decode() if with_text else None))
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"), x, strict=True)) for x in out], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Removes each word covered by a window of ``window`` words whose sequence
    also starts earlier (smaller doc_id, or same document and earlier start).

    Returns doc_id, n_words, n_removed, kept_sha256, spans (the maximal repeats
    removed, as word ranges) and kept_text (null unless with_text)."""
    tune(docs.sparkSession)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of(F.col("doc_id").cast("long")).alias("k"), F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("short").alias("s"), text.alias("text"))
    row = ["k", "s"]
    none = F.lit(None).cast("long")
    seeds = docs.select(*row, "text").mapInArrow(_seeds(window, gram), "h long, c long, k long, s short")
    shared = settle(seeds.join(seeds.groupBy("h").count().filter("count > 1").select("h"), "h", "left_semi"))
    blocks = settle(shared.groupBy("h", "c").agg(F.min(F.struct(*row)).alias("first")))
    whole = shared.join(blocks, ["h", "c"]).filter("k > first.k").select(*row, F.col("c").alias("block"), none.alias("window"))
    mixed = blocks.join(blocks.groupBy("h").count().filter("count > 1").select("h"), "h", "left_semi")
    lists = mixed.select("first.*", "c").groupBy(*row).agg(F.collect_set("c").alias("blocks"))
    windows = settle(docs.join(lists, row).select(*row, "text", "blocks").mapInArrow(_windows(window, gram), "h long, w long, k long, s short"))
    firsts = windows.groupBy("h", "w").agg(F.min("k").alias("first"), F.count("*").alias("n")).filter("n > 1")
    single = windows.join(firsts, ["h", "w"]).filter("k > first").select(*row, none.alias("block"), F.col("w").alias("window"))
    gone = whole.union(single).groupBy(*row).agg(F.collect_set("block").alias("blocks"), F.collect_set("window").alias("windows"))
    return docs.join(gone, row, "left").select("doc_id", "text", "blocks", "windows").mapInArrow(_cut(window, gram, with_text), RESULT)
