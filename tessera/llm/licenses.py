"""License scans: phrases, and an exact set-similarity join with license templates.

A template is a set of tokens; a text block (a line, or a paragraph of several lines)
matches if it contains at least ``threshold`` of the template's tokens. Both sides are
ordered by the tokens' frequency in the whole corpus, the rarest first, and joined by an
index of prefixes: a template of n tokens that needs an overlap of o is listed, with
positions, under its first n - o + 1 tokens, one of which any match must hold. The block's
tokens (those that any template has) are looked up in the same order. Length filter: the
block has o tokens. Positional filter, at each token met: those met so far and what is left
of either side after the two positions must still reach o. The template's side always does,
by the length of the prefix; the block's does not where too many of the tokens before are
other templates'. What is left is verified on all tokens.

Templates are a fixed list, so their index is sent to all tasks; blocks are never
shuffled, only the tokens' counts are summed. A block gives its best template's label
(all of the best, if equal); ``matches`` lists every template that reaches the threshold.

Defined results: null and empty texts have no words; a null doc_id is scanned like any
other; repeated rows have repeated results; an empty table gives an empty result; other
columns are not looked at."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import tune

THRESHOLD = 0.8
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND'),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
_words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words_of(text: str) -> list[str]:
    """Words after lower-casing A-Z only."""
    return _words(text.translate(_LOWER))


_LOWER = {c: c + 32 for c in range(65, 91)}
_BYTES = np.arange(256, dtype=np.uint8)
_TO_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_INSIDE = ((_TO_LOWER >= 0x30) & (_TO_LOWER <= 0x39)) | ((_TO_LOWER >= 0x61) & (_TO_LOWER <= 0x7A)) | (_TO_LOWER >= 0x80)


def _hash(tokens: list[str]) -> np.ndarray:
    """Hashes of the tokens, as word_hashes gives them."""
    buf, bounds = T.raw(pa.array(tokens, pa.string()))
    return T.word_hashes(buf, bounds[:-1], bounds[1:])


def _scan(column: pa.Array):
    """First row, bounds, row, line (of the part) and hash of each word, for the parts of a text column; lines end at \\n."""
    for at, part in T.slices(column):
        buf, bounds = T.raw(part)
        buf = _TO_LOWER[buf]
        starts, ends, rows = T.word_bounds(_INSIDE[buf], bounds)
        ends_of_lines = np.flatnonzero(buf == 10)
        line = np.searchsorted(ends_of_lines, starts) - np.searchsorted(ends_of_lines, bounds[:-1])[rows]
        yield at, bounds, rows, line, T.word_hashes(buf, starts, ends)


def _numbers(words: np.ndarray, hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The number of each word among the tokens with these hashes, -1 for none; order sorts the hashes."""
    at = order[np.minimum(np.searchsorted(hashes, words, sorter=order), len(hashes) - 1)]
    return np.where(hashes[at] == words, at, -1)


def frequencies(docs: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How often each of the tokens (a fixed list) stands in all texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        hashes = _hash(tokens)
        order = np.argsort(hashes)
        total = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for *_, words in _scan(batch.column(0)):
                found = _numbers(words, hashes, order)
                total += np.bincount(found[found >= 0], minlength=len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(total)], ["token", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {t: 0 for t in tokens} | {r.token: r.n for r in rows}


class Index:
    """The templates' tokens as numbers, the rarest first, and the templates by the tokens of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], threshold: float):
        texts = [sorted(set(words_of(text)), key=lambda t: (frequency.get(t, 0), t)) for _, text in templates]
        self.tokens = sorted({t for own in texts for t in own}, key=lambda t: (frequency.get(t, 0), t))
        number = {t: i for i, t in enumerate(self.tokens)}
        self.labels = [label for label, _ in templates]
        self.sets = [frozenset(number[t] for t in own) for own in texts]
        self.overlaps = [max(1, math.ceil(threshold * len(own) - 1e-9)) for own in texts]
        self.listed: dict[int, list[tuple[int, int]]] = {}
        for m, own in enumerate(texts):
            for i, t in enumerate(own[: len(own) - self.overlaps[m] + 1]):
                self.listed.setdefault(number[t], []).append((m, i))

    def candidates(self, block: list[int], dropped: dict[str, int] | None = None) -> list[int]:
        """Templates that a block (its tokens' numbers in order) may match; dropped counts what each filter has refused."""
        met: dict[int, int] = {}
        for j, token in enumerate(block):
            for m, i in self.listed.get(token, ()):
                so_far = met.get(m, 0)
                if so_far < 0:
                    continue
                if len(block) < self.overlaps[m]:
                    met[m] = -1
                    refused = "length"
                elif so_far + 1 + min(len(self.sets[m]) - i - 1, len(block) - j - 1) < self.overlaps[m]:
                    met[m] = -1
                    refused = "position"
                else:
                    met[m] = so_far + 1
                    continue
                if dropped is not None:
                    dropped[refused] = dropped.get(refused, 0) + 1
        return [m for m, n in met.items() if n > 0]

    def match(self, block: list[int]) -> list[tuple[int, float]]:
        """Template and containment of all templates that the block holds enough of."""
        own = frozenset(block)
        held = ((m, len(own & self.sets[m])) for m in sorted(self.candidates(block)))
        return [(m, n / len(self.sets[m])) for m, n in held if n >= self.overlaps[m]]


def blocks(lines: np.ndarray, tokens: np.ndarray, starting: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """First and last line, and the tokens' numbers in order, of the lines and paragraphs of a text that hold a prefix token.

    lines: the line of each word, ascending; tokens: its number or -1; starting: for each number, whether it is in a prefix.
    A paragraph is a run of lines with words."""
    hit = np.flatnonzero((tokens >= 0) & starting[tokens])
    if not len(hit):
        return
    own = np.unique(lines)
    new = np.concatenate(([True], np.diff(own) > 1))
    first = own[new]
    last = own[np.concatenate((new[1:], [True]))]
    spans = {(int(x), int(x)) for x in lines[hit]} | {(int(first[i]), int(last[i])) for i in np.unique(np.searchsorted(first, lines[hit], side="right") - 1)}
    for a, b in sorted(spans):
        part = tokens[np.searchsorted(lines, a) : np.searchsorted(lines, b, side="right")]
        yield a, b, np.unique(part[part >= 0]).tolist()


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("containment", pa.float64())])))])


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base (places of a phrase), first_word and last_word (smallest and largest start), base_labels,
    labels, score (1 with a phrase, else the best containment) and matches (label, lines, containment)."""
    tune(docs.sparkSession)
    tokens = sorted({t for _, text in templates for t in words_of(text)})
    index = Index(templates, frequencies(docs, tokens), threshold)
    spelled = [(p.split(), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]):
        hashes = _hash(index.tokens)
        order = np.argsort(hashes)
        starting = np.isin(np.arange(len(hashes)), list(index.listed))
        sought = [(_hash(p), label) for p, label in spelled]
        for batch in batches:
            out = []
            for at, bounds, rows, line, words in _scan(batch.column(1)):
                n_rows = len(bounds) - 1
                cut = np.searchsorted(rows, np.arange(n_rows + 1))
                places: dict[int, list[tuple[int, str]]] = {}
                for wanted, label in sought:
                    n = len(words) - len(wanted) + 1
                    if n > 0:
                        hit = rows[:n] == rows[len(wanted) - 1 :]
                        for j, h in enumerate(wanted):
                            hit &= words[j : n + j] == h
                        for i in np.flatnonzero(hit).tolist():
                            places.setdefault(int(rows[i]), []).append((i - int(cut[rows[i]]), label))
                found = _numbers(words, hashes, order) if len(words) else np.zeros(0, np.int64)
                candidates = set(rows[(found >= 0) & starting[found]].tolist())
                for r in range(n_rows):
                    base, matches, labels = places.get(r, ()), [], set()
                    if r in candidates:
                        for a, b, own in blocks(line[cut[r] : cut[r + 1]], found[cut[r] : cut[r + 1]], starting):
                            met = index.match(own)
                            best = max((c for _, c in met), default=0.0)
                            labels |= {index.labels[m] for m, c in met if c == best}
                            matches += [{"label": index.labels[m], "first_line": a, "last_line": b, "containment": c} for m, c in met]
                    out.append((base, {label for _, label in base}, labels, matches, int(cut[r + 1] - cut[r]), at + r))
            yield pa.RecordBatch.from_pylist([{
                "doc_id": batch.column(0)[i].as_py(), "n_words": n, "n_base": len(base), "first_word": min((p for p, _ in base), default=None), "last_word": max((p for p, _ in base), default=None),
                "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | labels)), "score": 1.0 if base else max((m["containment"] for m in matches), default=0.0), "matches": matches,
            } for base, own, labels, matches, n, i in out], schema=_RESULT)

    result = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_line:int,last_line:int,containment:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, result)
