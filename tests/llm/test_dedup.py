import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, exact, mixing, simhash, substring, textnum

from .util import awkward, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substring(rows, window=20):
    key = lambda i: -(2**63) if i is None else i
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone, own = set(), set()
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            if first[g] < key(i) or g in own:
                gone.update(range(p, p + window))
            own.add(g)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("make", [documents, awkward])
def test_substring(spark, make):
    df = make(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = substring.substring_dedup(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_substring(rows)
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substring_repetitive_and_shared(spark):
    random.seed(5)
    rows = []
    for i in range(60):  # few words, so that seeds repeat by chance with other neighbours
        rows.append((i, " ".join(random.choice("abc") for _ in range(random.choice((5, 19, 20, 21, 60, 200))))))
    base = [f"v{i}" for i in range(100)]
    for i in range(60, 90):
        a, b = sorted(random.sample(range(100), 2))
        rows.append((i, " ".join([f"u{i}", *base[a:b], f"t{i}", *base[a : a + 25]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring.substring_dedup(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_substring(rows)


def test_substring_structured_words_differ(spark):
    thue = "a"
    for _ in range(10):
        thue = "".join("ab" if c == "a" else "ba" for c in thue)
    other = thue.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(19)]
    runs = [" ".join(x) for x in (thue, other)]  # the same, word by word
    rows = [(1, " ".join([*words, thue])), (2, " ".join([*words, other])), (3, runs[0]), (4, runs[1]), (5, "x" * 300 + "y " + " ".join(words)), (6, "x" * 300 + "z " + " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.substring_dedup(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_substring(rows)
    assert {r.doc_id: r.n_removed for r in got}[2] == 0


def test_sequence_hashes_tell_sequences_apart():
    rng = random.Random(1)
    words = np.array([rng.choice((3, 5, 2**60)) for _ in range(500)], np.uint64)
    starts, lengths = np.array([rng.randrange(400) for _ in range(3000)]), np.array([rng.randrange(1, 100) for _ in range(3000)])
    got = textnum.sequence_hashes(words, starts, lengths)
    by = defaultdict(set)
    for h, a, n in zip(got.tolist(), starts, lengths, strict=True):
        by[tuple(words[a : a + n].tolist())].add(h)
    assert all(len(x) == 1 for x in by.values()) and len({h for x in by.values() for h in x}) == len(by)
    assert (textnum.rolling_hashes(words, 7) == textnum.sequence_hashes(words, np.arange(494), np.full(494, 7))).all()


def brute_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("make", [documents, awkward])
def test_simhash(spark, make):
    df = make(spark)
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
    root = brute_components(sorted({f for _, f in rows}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for i, f in rows:
        least[root[f]] += [i] if i is not None else []
    want = [(i, f"{f:016x}", min(least[root[f]], default=None)) for i, f in rows]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("distance", "segments", "hot"), [(2, 2, 64), (2, 2, 2)])
def test_links_find_every_pair(spark, distance, segments, hot):
    random.seed(3)
    fps = {0, 1, 3, 2**63, 2**64 - 1}
    for low in (64, 64, 32, 16):  # families that differ anywhere, or in the last bits only, so that values are crowded
        x = random.getrandbits(64)
        for _ in range(40):
            y = x
            for b in random.sample(range(low), random.choice((1, 2, 3))):
                y ^= 1 << b
            fps |= {x, y}
    signed = sorted(x - 2**64 if x >> 63 else x for x in fps)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= distance}
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, segments, hot).collect()]
    assert len(got) == len(want) and set(got) == want


def test_radii_leave_no_pair_out():
    for distance in range(7):
        for parts in range(1, 6):
            assert sum(r + 1 for r in simhash.radii(distance, parts)) == distance + 1 or distance < parts - 1


def test_components_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(edges).collect()
    assert len(got) == 301 and {r.root for r in got} == {0}


@pytest.mark.parametrize("make", [documents, awkward])
def test_exact(spark, make):
    df = make(spark)
    rows = [(r.doc_id, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")) for r in df.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = sorted(((i, best[t], len(groups[t]), i == best[t]) for i, t in rows), key=str)
    for full in (False, True):
        got = exact.exact_dedup(df, digest_all=full).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == want
    sha = {hashlib.sha256(t.encode()).hexdigest() for _, t in rows}
    assert {r.text_sha256 for r in got} == sha


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in full]
        level = (total - sum(3 * sizes[s] for s in full)) / max(1, sum(w[s] for s in left))
        over = {s for s in left if w[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else w[s] * level for s in names}
        full |= over


@pytest.mark.parametrize("make", [lambda s: documents(s, "/root/testdata/sf0.01"), awkward])
def test_mixing(spark, make):
    df = make(spark)
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    sizes, taken, goal, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    text = sorted(len(WORD.findall(r.text or "")) for r in df.collect())
    assert sorted(r["size"] for r in got) == text
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        goal[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
    want = brute_targets(sizes)
    for s in sizes:
        assert goal[s] == pytest.approx(want[s])
        assert abs(taken[s] - goal[s]) <= largest[s]
    key = lambda r: str((r.doc_id, r.source, r["size"], r.taken))
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(7)).collect()))


def test_mixing_hot_source_is_near(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("source"), F.repeat(F.lit("a "), (1 + F.col("id") * 37 % 400).cast("int")).alias("text"))
    by = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 400 for r in by)


def test_mixing_includes_each_document_by_its_share(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    seen, runs = defaultdict(int), 5
    for seed in range(runs):
        for r in mixing.mix(df, seed=seed).collect():
            seen[r.doc_id] += r.copies
            rate = r.target / r.source_size
            assert r.copies in (math.floor(rate), math.floor(rate) + 1)
    for source in (0, 1):
        rate = {0: 2 / 3, 1: 4 / 3}[source]
        own = [seen[i] / runs for i in range(source, 60, 2)]
        assert all(abs(x - rate) < 4.5 * math.sqrt(rate % 1 * (1 - rate % 1) / runs) for x in own)
        assert abs(np.mean(own) - rate) < 0.08


def test_mixing_takes_repeated_rows_by_their_share(spark):
    rows = [(1, "five words are in this", "a")] * 3000 + [(2, "w " * 4000, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    own = [r for r in got if r.doc_id == 1]
    assert len(got) == 3001 and abs(sum(r.taken for r in own) - own[0].target) <= 5


def test_empty_tables(spark):
    e = empty(spark)
    for out in (substring.substring_dedup(e), simhash.simhash_groups(e), exact.exact_dedup(e), mixing.mix(e)):
        assert out.collect() == []
