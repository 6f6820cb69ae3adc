"""Numpy kernels over the UTF-8 bytes of many texts at once: word bounds, 64-bit
word hashes, hashes of word sequences, and winnowing.

Separators are ASCII, so bytes give the same words as code points. A word's hash takes
its bytes eight at a time, each eight put through a finaliser, so no structure of the
text (as there is for polynomials modulo 2**64) makes different words meet. Sequences
are hashed by doubling: two halves of 2**k words, mixed, and any length as two such
halves that overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import SLICE_BYTES

_START, _EIGHT, _LEFT, _RIGHT = (np.uint64(x) for x in (0x243F6A8885A308D3, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5))
#: Words of more bytes are hashed one by one.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _LEFT + right * _RIGHT)


def sequence_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of words[start : start + length], from the words' hashes; alike wherever the sequence stands. Lengths are 1 or more."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    power = np.frexp(lengths.astype(float))[1] - 1  # 2**power <= length
    level = words
    for k in range(int(power.max()) + 1):
        at = np.flatnonzero(power == k) if power.min() != power.max() else slice(None) if power[0] == k else []
        out[at] = _joined(level[starts[at]] + lengths[at].astype(np.uint64), level[starts[at] + lengths[at] - (1 << k)])
        level = _joined(level[: len(level) - (1 << k)], level[1 << k :])
    return out


def rolling_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all sequences of one length."""
    n = max(0, len(words) - length + 1)
    return sequence_hashes(words, np.arange(n), np.full(n, length))


def slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a string column of about SLICE_BYTES, with the row each begins at; one longer text is a part of its own."""
    at, n = 0, len(column)
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield at, column.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: none) and the bounds of its rows."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return buf, bounds - bounds[0]


def is_word_byte(buf: np.ndarray) -> np.ndarray:
    return (buf != 0x20) & ((buf < 9) | (buf > 13))


def word_bounds(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes, which end at row bounds too, and the row of each."""
    n = len(inside)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before = np.concatenate(([False], inside[:-1])) & ~cut[:-1]
    after = np.concatenate((inside[1:], [False])) & ~cut[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(bounds, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.full(len(starts), _START, np.uint64)
    if not len(starts):
        return out
    eight = np.concatenate((buf, np.zeros(8, np.uint8))).astype(np.uint64)
    for k in (1, 2, 4):  # the eight bytes from each place on
        eight[:-k] |= eight[k:] << np.uint64(8 * k)
    size = ends - starts
    long = np.flatnonzero(size > _LONG)
    live, at = np.flatnonzero(size <= _LONG), 0
    while len(live):
        left = size[live] - at
        chunk = eight[starts[live] + at]
        chunk &= np.uint64(2**64 - 1) >> (np.uint64(8) * np.maximum(0, 8 - left).astype(np.uint64))
        out[live] = mix((out[live] ^ chunk) * _EIGHT + np.minimum(left, 8).astype(np.uint64))
        live, at = live[left > 8], at + 8
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbours, by doubling."""
    have, m = 1, x
    while 2 * have <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - have : width - have + len(x) - width + 1])


def winnow(words: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of all windows of so many words that lie in one row.

    A window's seed is the least hash among its grams, so equal windows have
    equal seeds. Returns, for each run of windows with one seed: first window's
    word, last window's word, seed, and the hash of all words the run covers."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    seeds = sliding_min(rolling_hashes(words, gram), window - gram + 1)
    valid = rows[: n - window + 1] == rows[window - 1 :]
    change = np.ones(len(seeds), bool)
    change[1:] = (seeds[1:] != seeds[:-1]) | (rows[1 : len(seeds)] != rows[: len(seeds) - 1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    stop = np.flatnonzero(np.concatenate((change[1:] | ~valid[1:], [True])) & valid)
    return first, stop, seeds[first], sequence_hashes(words, first, stop + window - first)
