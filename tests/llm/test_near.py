import numpy as np
import pytest

import corpus_pipeline as P
from tessera.llm import near

from .test_dedup import brute_components, brute_fingerprint
from .util import awkward, documents, empty


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(a, b):
    shared = len(shingles(a) & shingles(b))
    return shared >= 0.8 * max(1, len(shingles(a) | shingles(b))) or (brute_fingerprint(a) ^ brute_fingerprint(b)).bit_count() <= 2


def test_near_stage_drops_what_is_similar(spark):
    ids = [1, 177, 6, 145, 0, 2, 3]
    docs = documents(spark).filter(f"doc_id in ({', '.join(map(str, ids))})")
    text = {r.doc_id: r.text for r in docs.collect()}
    assert linked(text[1], text[177]) and (brute_fingerprint(text[1]) ^ brute_fingerprint(text[177])).bit_count() > 2
    root = brute_components(sorted(ids), lambda a, b: linked(text[a], text[b]))
    assert {r.doc_id for r in P.near_stage(spark, docs, "").collect()} == set(root.values())


def test_near_groups_find_chains_and_hot_groups(spark):
    base = [f"b{i}" for i in range(120)]
    texts = {i: " ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(60)}
    texts |= {100 + k: " ".join(f"c{i}" for i in range(6 * k, 6 * k + 100)) for k in range(12)}  # each like its neighbours only
    texts |= {200 + k: " ".join([f"s{i}" for i in range(60)] + [f"t{k}_{i}" for i in range(20)]) for k in range(30)}  # many candidates, not alike
    texts |= {300: "one two", 301: "One  two", 302: "one three"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    sets = {i: shingles(t) for i, t in texts.items()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(sorted(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {}
    for r in near.near_groups(df).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i in want if want[i] == k) for k in set(want.values()))


@pytest.mark.parametrize("tile", [None, 20])
def test_near_groups_make_no_row_for_each_pair(spark, monkeypatch, tile):
    """Copies whose similarity lies about the limit: nearly every pair meets in some band and passes the sketches."""
    rng = np.random.default_rng(4)
    texts = {}
    for i in range(200):
        words = [f"w{k}" for k in range(1000)]
        for k in rng.choice(1000, 13, replace=False):
            words[k] = f"x{i}_{k}"
        texts[i] = " ".join(words)
    sets = {i: shingles(t) for i, t in texts.items()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(sorted(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2)
    assert 5 < len(set(want.values())) < len(texts)
    verified, made, alike = [], [], near._alike
    monkeypatch.setattr(near, "_alike", lambda pairs, *rest: (verified.append(pairs.count()), alike(pairs, *rest))[1])
    if hasattr(near, "_cross"):
        cross = near._cross
        monkeypatch.setattr(near, "_cross", lambda *rest: (made.append(cross(*rest)), made[-1])[1])
    if tile:
        monkeypatch.setattr(near, "TILE", tile, raising=False)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {}
    for r in near.near_groups(df).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i in want if want[i] == k) for k in set(want.values()))
    assert sum(verified) < len(texts) ** 2 / 5, verified
    assert all(x.count() < 10 * len(texts) for x in made)


def test_near_groups_of_awkward_rows(spark):
    assert near.near_groups(awkward(spark)).count() == awkward(spark).count()
    assert near.near_groups(empty(spark)).collect() == []


def test_stages_keep_one_of_rows_that_repeat_the_largest_id(spark):
    rows = [(7, "same text", "a"), (7, "same text", "b"), (7, "Same text", "a"), (3, "same text", "a"), (None, "only nulls here", "a"), (None, "Only nulls here", "a"), (None, "only nulls here", "b"), (9, None, "a"), (9, "", "a"), (1, "alone", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = P.exact_stage(spark, docs, "").collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in kept if r.doc_id is not None) == [(1, "alone"), (7, "same text"), (9, "")]
    assert [r.text.lower() for r in kept if r.doc_id is None] == ["only nulls here"]
    near_kept = P.near_stage(spark, docs.filter("text = 'same text' or text = 'alone'"), "").collect()
    assert sorted((r.doc_id, r.text) for r in near_kept) == [(1, "alone"), (3, "same text")]
    again = spark.createDataFrame(rows[:2], docs.schema)
    assert [(r.doc_id, r.source) for r in P.near_stage(spark, again, "").collect()] == [(7, "a")]
