"""Token counts of a unigram tokenizer, by count-only Viterbi.

A blank is written as the mark U+2581, a mark is put before the text, and marks begin
the units that are tokenized one by one. In a unit, an Aho-Corasick automaton
enumerates all vocabulary matches by their end, and dynamic programming carries the
best score and the piece count at each end; pieces themselves are never kept. Rules
of the tokenizer: a later candidate wins only with a higher score, candidates come
from the earliest start on; a character without a match of its own may be unknown, at
the least score less 10; unknown characters become bytes.

The vocabulary is a public piece list with the scores of Zipf's law for the list's
order (the list has no unigram scores of its own, and no tokenizer is trained here).

Equal units are counted once while they are in a cache of a fixed size, which changes
no result. Each row is counted where it is: no shuffle.

Defined results: null and empty texts have 0 units and tokens; doc_id may be null or
repeat; an empty table gives an empty result; other columns are not looked at."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

MARK, CACHE = "▁", 200_000


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces with scores, in id order; id 0 is unknown. Control and byte pieces have the least score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    rank = [math.inf if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) else i for i in range(n)]
    return [(model.id_to_piece(i), -math.log(min(r, n) + 1)) for i, r in enumerate(rank)]


class Counter:
    """Counts pieces; vocabulary as (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]], cache: int = CACHE):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - 10.0
        self.known: dict[str, int] = {}
        self.cache = cache
        self.units = re.compile(f"{MARK}[^{MARK}]*", re.S).findall

    def unit(self, word: str) -> int:
        n = len(word)
        score, count, seen = [0.0] + [-math.inf] * n, [0] * (n + 1), 0
        matches = self.automaton.iter(word)
        end, (length, own) = next(matches, (n, (0, 0.0)))
        while seen < n:
            single = False
            best, pieces = -math.inf, 0
            while end == seen:
                start = seen + 1 - length
                got = score[start] + own
                if got > best:
                    best, pieces = got, count[start] + 1
                single |= length == 1
                end, (length, own) = next(matches, (n, (0, 0.0)))
            if not single and score[seen] + self.unknown > best:
                best, pieces = score[seen] + self.unknown, count[seen] + len(word[seen].encode())
            seen += 1
            score[seen], count[seen] = best, pieces
        return count[n]

    def text(self, text: str | None) -> tuple[int, int]:
        """Units and tokens."""
        if not text:
            return 0, 0
        text = text.replace(" ", MARK)
        units = self.units(text if text[0] == MARK else MARK + text)
        total = 0
        for u in units:
            got = self.known.get(u)
            if got is None:
                got = self.unit(u)
                if len(u) <= 64:
                    if len(self.known) >= self.cache:
                        self.known.clear()
                    self.known[u] = got
            total += got
        return len(units), total


def token_counts(docs: DataFrame, pieces: str | None = None) -> DataFrame:
    """doc_id, n_units, n_tokens. pieces: path of the piece list, read by the driver."""
    spark = tune(docs.sparkSession)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(pieces or default_pieces()))

    def run(batches: Iterator[pa.RecordBatch]):
        counter = Counter(vocabulary.value)
        for batch in batches:
            got = [counter.text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())], ["doc_id", "n_units", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_units long, n_tokens long")
