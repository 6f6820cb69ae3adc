"""Byte-level BPE by a global shuffle of distinct words.

Texts are split into pre-tokens, and a chunk of about CHUNK bytes of texts becomes
its distinct pre-tokens and, for every text, their positions. The words go to
buckets by hash, in which each distinct word is encoded once, however many chunks
hold it; the ids go back to their chunks and are put in place by position. Decoding
joins the ids with the table of token bytes. What would be a row for each pre-token
is a packed block for each chunk and bucket, so a shuffle carries a word at most
once a chunk, and positions in about ten bits; no text is shuffled.

Chunks and buckets are bounded: a chunk by CHUNK (or one longer text), a bucket by
its share of the distinct words. Rows are told apart by their place in the chunk,
not by doc_id. Packed chunks go through one exchange by chunk, which both the words'
way and the texts' places read, so they are packed once and stored once; a lost part
of it is packed again alike as long as docs are read from files (settle() them first
if they are not), and a chunk whose words do not all come back is an error.

Defined results: null is the empty text, which has no ids; null and repeated
doc_ids are rows like any other; an empty table gives an empty result."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

CHUNK = 16 << 20
_PACKED = "chunk long, bucket int, n int, words binary, docs binary, lengths binary, places binary"
_FIELDS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("words", pa.binary()), ("docs", pa.binary()), ("lengths", pa.binary()), ("places", pa.binary())])


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers leave the higher planes empty."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words))


def _unpack_words(n: int, data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = (4 * n + np.cumsum(np.frombuffer(raw, "<u4", n))).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1]], ends, strict=True)]


def _packed_rows(chunk: int, buckets: int, index: dict[str, int], docs: list, lengths: list[int], places: list[np.ndarray]) -> pa.RecordBatch:
    """The rows of a chunk: words of each bucket in order, and a row of doc_ids, lengths and places; a place is the
    rank of the word by frequency, and the ranks' order follows the places."""
    words = [w.encode() for w in index]
    of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = sorted(range(len(words)), key=lambda i: (of[i], words[i]))
    flat = np.concatenate(places) if places else np.zeros(0, np.int64)
    frequent = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[frequent] = np.arange(len(words))
    cuts = np.searchsorted(of[order], np.arange(buckets + 1)) if words else np.zeros(buckets + 1, np.int64)
    rows = []
    for b in range(buckets):
        if own := [words[i] for i in order[cuts[b] : cuts[b + 1]]]:
            rows.append({"chunk": chunk, "bucket": b, "n": len(own), "words": _pack_words(own)})
    ids = pa.array(docs, pa.int64())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as out:
        out.write_batch(pa.record_batch([ids], ["doc_id"]))
    rows.append({"chunk": chunk, "bucket": -1, "n": len(docs), "docs": sink.getvalue().to_pybytes(), "lengths": _pack(np.array(lengths)), "places": _pack(np.concatenate((rank[order] if words else np.zeros(0, np.int64), rank[flat] if len(flat) else np.zeros(0, np.int64)))), "words": _pack(np.array([len(words)]))})
    return pa.RecordBatch.from_pylist(rows, schema=_FIELDS)


def _chunks(pattern: str, buckets: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]):
        import regex

        split = regex.compile(pattern).findall
        part, made = TaskContext.get().partitionId(), 0
        index, docs, lengths, places, held = {}, [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                value = text.as_py() or ""
                own = np.fromiter((index.setdefault(w, len(index)) for w in split(value)), np.uint32)
                docs.append(doc.as_py())
                lengths.append(len(own))
                places.append(own)
                held += len(value)
                if held >= size:
                    yield _packed_rows((part << 24) + made, buckets, index, docs, lengths, places)
                    made += 1
                    index, docs, lengths, places, held = {}, [], [], [], 0
        if docs:
            yield _packed_rows((part << 24) + made, buckets, index, docs, lengths, places)

    return run


def _only_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter in Python: one in SQL would move below the exchange and make it two."""
    for batch in batches:
        yield batch.filter(pc.greater_equal(batch.column(1), 0)).select(["chunk", "bucket", "n", "words"])


def _encode(ranks_data):
    """Words of a bucket to ids, each distinct word once; blocks of a bucket stand together."""

    def run(batches: Iterator[pa.RecordBatch]):
        import tiktoken

        # a pattern that takes all of a word: it has been split before
        encode = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(ranks_data.value), special_tokens={}).encode_ordinary
        known, bucket = {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    known, bucket = {}, row["bucket"]
                ids, lengths = [], []
                for w in _unpack_words(row["n"], row["words"]):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encode(w.decode())
                    ids += got
                    lengths.append(len(got))
                yield pa.RecordBatch.from_pylist([{"chunk": row["chunk"], "bucket": bucket, "n": row["n"], "lengths": _pack(np.array(lengths)), "ids": _pack(np.array(ids))}], schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("lengths", pa.binary()), ("ids", pa.binary())]))

    return run


def gather(offsets: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of all elements of the spans listed in which, in order."""
    n = lengths[which]
    ends = np.cumsum(n)
    return np.repeat(offsets[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def byte_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and offset and length by id."""
    size = max(ranks.values(), default=-1) + 1
    tokens = [b""] * size
    for token, i in ranks.items():
        tokens[i] = token
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def _reassemble(ranks_data, with_ids: bool):
    table: list = []

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not table:
            table.extend(byte_table(read_ranks(ranks_data.value)))
        token_bytes, token_at, token_len = table
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids)
        if not left.num_rows:
            return schema.empty_table()
        head = left.filter(pc.less(left.column("bucket"), 0)).to_pylist()[0]
        n_words = int(_unpack(head["words"])[0])
        places = _unpack(head["places"])
        rank_of, places = places[:n_words], places[n_words:]
        blocks = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        lens = np.concatenate([_unpack(r["lengths"]) for r in blocks] or [np.zeros(0, np.uint32)]).astype(np.int64)
        ids = np.concatenate([_unpack(r["ids"]) for r in blocks] or [np.zeros(0, np.uint32)])
        if len(lens) != n_words:
            raise RuntimeError(f"chunk {head['chunk']}: {len(lens)} of {n_words} words came back")
        word_at, word_len = np.empty(n_words, np.int64), np.empty(n_words, np.int64)
        word_at[rank_of], word_len[rank_of] = np.cumsum(lens) - lens, lens
        with pa.ipc.open_stream(head["docs"]) as stream:
            docs = stream.read_all().column(0).combine_chunks()
        n, ids_sha, decoded_sha, kept, at = [], [], [], [], 0
        for length in _unpack(head["lengths"]).tolist():
            own = ids[gather(word_at, word_len, places[at : at + length])]
            at += length
            n.append(len(own))
            ids_sha.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            decoded_sha.append(hashlib.sha256(token_bytes[gather(token_at, token_len, own)].tobytes()).hexdigest())
            if with_ids:
                kept.append(own)
        columns = [docs, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(kept).astype(np.int32), pa.int32())))
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, with_ids: bool = True, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit), decoded_sha256 (decoded bytes) and ids.

    ranks: path of a rank file (token in base64, rank), read by the driver."""
    spark = tune(docs.sparkSession)
    with open(ranks or default_ranks(), "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    pattern = pattern or default_pattern()
    # as many partitions as the scan has, if it has more: a task's share does not grow with the table
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select("text").rdd.getNumPartitions())
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = base.mapInArrow(_chunks(pattern, max(64, 2 * parts), chunk), _PACKED).repartition(parts, "chunk")
    words = packed.mapInArrow(_only_words, "chunk long, bucket int, n int, words binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    ids = words.mapInArrow(_encode(data), "chunk long, bucket int, n int, lengths binary, ids binary")
    result = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return packed.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_reassemble(data, with_ids), result)


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """Adds the column decoded (binary) to a table with doc_id and ids, by the token-byte table. Null ids give null."""
    spark = tune(encoded.sparkSession)
    with open(ranks or default_ranks(), "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]):
        token_bytes, token_at, token_len = byte_table(read_ranks(data.value))
        for batch in batches:
            out = [None if x.as_py() is None else token_bytes[gather(token_at, token_len, np.array(x.as_py(), np.int64))].tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
