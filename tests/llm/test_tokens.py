import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import bpe, unigram

from .util import awkward, documents, empty


def sha(x):
    return hashlib.sha256(x).hexdigest()


def texts():
    random.seed(2)
    pool = ["the", " and", "É", "ß", "日本", "\n\n", "  ", "\t", "'s", "'LL", "1234", "٣", "😀", "‍", "á", "x" * 50, "...", " ", "▁", "<s>", "<0x0A>", "\x00", " ", "ǅ", "Ⅷ", "²"]
    return ["".join(random.choice(pool) for _ in range(random.randrange(40))) for _ in range(300)]


def pairs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("make", [documents, awkward, pairs])
def test_bpe_equals_the_library(spark, make):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(open(bpe.default_ranks(), "rb").read())
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = make(spark)
    want = []
    for r in df.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode()), ids))
    got = bpe.encode(df, chunk=20000)
    rows = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    decoded = sorted((str(r.doc_id), sha(r.decoded)) for r in bpe.decode(got).collect())
    assert decoded == sorted((str(r[0]), r[3]) for r in want)


@pytest.mark.parametrize("make", [documents, awkward, pairs])
def test_unigram_equals_the_library(spark, make):
    from tokenizers import Tokenizer, models, pre_tokenizers

    library = Tokenizer(models.Unigram(unigram.read_vocabulary(unigram.default_pieces()), 0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.MARK, prepend_scheme="always", split=True)
    df = make(spark)
    want = sorted(((r.doc_id, len(library.encode(r.text).ids) if r.text else 0) for r in df.collect()), key=str)
    got = sorted(((r.doc_id, r.n_tokens) for r in unigram.token_counts(df).collect()), key=str)
    assert got == want


def test_unigram_ties():
    a, b = -1.0, -2.0
    c = unigram.Counter([("?", -5.0), ("a", a), ("b", a), ("ab", b), ("abc", b), ("c", math.nextafter(0, -1))])
    assert c.unit("ab") == 1  # the tie goes to the earlier start
    assert c.unit("zab") == 2 and c.unit("éab") == 3


def test_empty(spark):
    assert bpe.encode(empty(spark)).collect() == [] and unigram.token_counts(empty(spark)).collect() == []
