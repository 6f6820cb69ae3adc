import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, forest, licenses, toxicity

from .util import awkward, documents, empty

CHECK = "/root/testdata/sf0.1"


def test_grammar_scores_clauses():
    m = toxicity.Model()
    assert m.score("you idiot") > 0.5 > m.score("an idiot") > m.score("a nice day")
    assert m.score("i will kill you") > 0.5 > m.score("to kill time") > m.score("")
    assert m.score("you idiot") > m.score("you are not an idiot") and m.score("she said you idiot") < 0.5
    assert m.score("they said: you idiot") < 0.5 < m.score("they said. you idiot")  # a report ends with its sentence
    assert m.score("not this, you idiot") > 0.5  # a negation with its clause
    assert m.score("you. an idiot") < 0.5 < m.score("you an idiot")
    strong = toxicity.Model({"idiot": 50.0}, (-1.0, *[9.0] * len(toxicity.PATTERNS)))
    assert strong.score("an idiot") < 0.5 < strong.score("an idiot, an idiot")  # one word in passing


def brute_clauses(model, text):
    """The patterns of each clause by its words alone, without states."""
    out, reported = [], False
    for part in re.findall(r"[^.!?;:,\n]*[.!?;:,\n]", text.lower() + "."):
        end = part[-1]
        words = toxicity._WORD(part)
        kinds = [toxicity.SYMBOLS[model.symbol(w)[0]] for w in words]
        reported |= "report" in kinds
        hits = [i for i, k in enumerate(kinds) if k in ("insult", "threat")]
        negated = [any(k == "negation" for k in kinds[max(0, i - toxicity.SPAN) : i]) for i in hits]
        mode = "reported" if reported else "negated" if hits and all(negated) else "plain"
        for word, alone, both in (("insult", "bare", "aimed"), ("threat", "loose", "threat")):
            if word in kinds:
                weight = sum(model.symbol(w)[1] for w, k in zip(words, kinds, strict=True) if k == word)
                out.append((both if "target" in kinds else alone, mode, weight, " ".join(words)))
        reported &= end in ",;:"
    return out


def test_grammar_is_the_composition():
    rng = random.Random(1)
    m = toxicity.Model({"zork*": 3.0, "clown": -1.0})
    pool = ["idiot", "kill", "you", "not", "said", "zorkly", "clown", "the", "dog", ",", ".", ":", "!", "\n"]
    for _ in range(300):
        text = " ".join(rng.choices(pool, [2, 2, 2, 2, 1, 1, 1, 4, 4, 2, 2, 1, 1, 1], k=rng.randrange(1, 60)))
        got = [(*toxicity.PATTERNS[p], w, c) for p, w, c in m.clauses(text)]
        assert [(a, b, c) for a, b, _, c in got] == [(a, b, c) for a, b, _, c in brute_clauses(m, text)]
        assert [w for _, _, w, _ in got] == pytest.approx([w for _, _, w, _ in brute_clauses(m, text)])


def syntactic(spark, n=1500):
    """Documents in which only the clause tells: insults aimed at someone are toxic; denied, reported and passing ones are not."""
    rng = random.Random(4)
    filler = [a + b for a in ("ba", "ko", "ri", "tu", "sel") for b in ("dan", "mer", "lo", "pik", "vas", "ne")]
    insults = ["grobnik", "zorkel", "plumf", "snidge"]
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        clauses = [" ".join(rng.choices(filler, k=rng.randrange(4, 9))) for _ in range(40)]
        for at in rng.sample(range(40), 2):
            bad, some = rng.choice(insults), " ".join(rng.choices(filler, k=2))
            shapes = (f"you {some} {bad}", f"{bad} {some} you") if toxic else (f"they are not a {bad} {some}", f"{some} said you {bad}", f"no {bad} {some} of them")
            clauses[at] = rng.choice(shapes)
        if not toxic:  # as many targets, apart from the insults
            clauses[rng.randrange(40)] += ". you " + rng.choice(filler)
        rows.append((i, ". ".join(clauses), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")


def test_toxicity_depends_on_the_clause(spark):
    docs, labels = syntactic(spark)
    # clean texts use the insults too, so that words alone tell little; what the lexicon would learn by itself is given
    texts = docs.join(labels, "doc_id").filter(~toxicity.held_out(F.col("doc_id")))
    m = toxicity.Model({w: 4.0 for w in ("grobnik", "zorkel", "plumf", "snidge")})
    x, y = toxicity._features_of(texts.select("text", "toxic"), m)
    m.weights = toxicity._fit(x, y)
    held = docs.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    rng = random.Random(2)

    def shuffled(text):
        words = re.findall(r"\w+|\.", text)
        rng.shuffle(words)
        return " ".join(words)

    recall = lambda change: np.mean([m.score(change(r.text)) >= 0.5 for r in held if r.toxic])
    alarm = np.mean([m.score(r.text) >= 0.5 for r in held if not r.toxic])
    assert recall(lambda t: t) > 0.95 and alarm < 0.05
    assert recall(shuffled) < 0.5 * recall(lambda t: t)


def test_toxicity_on_held_out_documents(spark):
    docs, labels = documents(spark, CHECK), spark.read.parquet(f"{CHECK}/labels.parquet")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").toPandas()
    assert set(got.predicted) <= {0, 1} and got.score.between(0, 1).all()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.85 and (clean.predicted == 0).mean() > 0.98


def test_toxicity_held_out_labels_are_not_used(spark):
    docs, labels = documents(spark), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, flipped)
    assert a.learned == b.learned and a.weights == b.weights
    got = toxicity.score(docs, a, with_clauses=True).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_toxicity_awkward(spark):
    df = awkward(spark)
    none = spark.createDataFrame([(None, 1, None)], "doc_id long, quality int, toxic int")
    m = toxicity.learn(df, none)
    got = toxicity.score(df, m).collect()
    assert len(got) == df.count() and {r.predicted for r in got} == {0}  # one insult and no more
    assert toxicity.score(empty(spark), m).collect() == []


def brute_nearest(rows, queries, k=5):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], float)
    out = {}
    for i, q in queries:
        s = (v * np.array(q, float)).sum(axis=1) / (np.sqrt((v**2).sum(axis=1)) * np.sqrt((np.array(q, float) ** 2).sum()))
        out[i] = sorted(((-b, a) for a, b in zip(ids.tolist(), s.tolist(), strict=True) if a != i))[:k]
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", CHECK])
def test_forest_recall_and_scores(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute_nearest(rows, [r for r in rows if r[0] % 50 == 0])
    got = forest.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    vectors = {i: np.array(v, float) for i, v in rows}
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(x == sorted(x) and len(x) == 5 for x in found.values())
    recall = np.mean([len({i for _, i in found[q]} & {i for _, i in w}) / 5 for q, w in want.items()])
    assert recall >= 0.9


def test_forest_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0, 1.0]), (10, [-1.0, 0.0])]
    rows += [(i, [1.0, 0.0]) for i in range(100, 150)] + [(8, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, block int, v int")
    got = forest.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.score) for r in got if r.query_id == 0] == [(1, 1.0), (50, 1.0), (100, 1.0), (101, 1.0), (102, 1.0)]
    assert {r.query_id for r in got} == {0, 50, 100}
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in forest.nearest(few, few.filter("vec_id = 0")).collect()] == [(1, 1)]
    assert forest.nearest(df.limit(0), df.limit(0)).collect() == []


def test_forest_tiny_and_huge_vectors(spark):
    rows = [(0, [1e-170, 0.0]), (50, [2.0**1000, 2.0**1000]), (1, [5e-324, 5e-324]), (2, [0.0, 1e308]), (3, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 3), (0, 1), (0, 50), (0, 2), (50, 1), (50, 3), (50, 0), (50, 2)]
    assert [r.score for r in got[:3]] == pytest.approx([1 / 1.25**0.5, 0.5**0.5, 0.5**0.5], abs=1e-12)


def test_forest_candidates_are_those_of_the_level(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((400, 16))
    trees, bits, probes, least = 3, 12, 4, 60
    entries = spark.createDataFrame([(i, 16, x.tolist()) for i, x in enumerate(v)], "id long, dim int, v array<double>").repartition(3)
    got = forest.candidates(entries, entries.filter("id < 20"), trees, bits, probes, least).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    h = forest.Hasher(16, np.round(unit.mean(axis=0), 6), trees, bits)
    projected = h.project(unit)
    own = h.strings(projected)
    for q in range(20):
        strings = [[(int(own[q, t]) ^ turn, start) for turn, start in some] for t, some in enumerate(h.turned(projected[q], probes))]
        met = lambda level: [{i for i in range(400) for s, start in strings[t] if start <= level and int(own[i, t]) >> (bits - level) == s >> (bits - level)} for t in range(trees)]  # noqa: B023, E731
        level = max((x for x in range(bits + 1) if sum(map(len, met(x))) >= least), default=0)
        assert {r.e for r in got if r.q == q} == set().union(*met(level))


def test_forest_meets_all_of_a_dense_group(spark):
    """Distinct vectors that share all strings, more than a run holds, and closer than sketches can tell; others about them."""
    rng = np.random.default_rng(1)
    v = np.concatenate((rng.standard_normal(8) + 1e-5 * rng.standard_normal((1500, 8)), rng.standard_normal((500, 8))))
    rows = [(i, x.tolist()) for i, x in enumerate(v[rng.permutation(len(v))])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = brute_nearest(rows, [r for r in rows if r[0] % 50 == 0])
    was, forest.RUN = forest.RUN, 500
    try:
        got = forest.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    finally:
        forest.RUN = was
    scores = {q: [-s for s, _ in w] for q, w in want.items()}
    assert len(got) == 5 * len(want) and all(r.score == pytest.approx(scores[r.query_id][r["rank"] - 1], abs=1e-14) for r in got)


def test_forest_makes_no_row_for_each_pair_of_a_dense_group(spark, monkeypatch):
    """Closer than sketches can tell, or of equal cosine: runs give few rows, and the nearest are still exact."""
    rng = np.random.default_rng(3)
    v = np.concatenate((rng.standard_normal(8) + 1e-5 * rng.standard_normal((1200, 8)), rng.standard_normal((400, 8))))
    rows = [(i, x.tolist()) for i, x in enumerate(v[rng.permutation(len(v))])]
    rows += [(10000 + i, [c, 2 * c, 2 * c]) for i, c in enumerate((2.0 * rng.permutation(800) + 1).tolist())]  # all 1.0
    made, run = spark.sparkContext.accumulator(0), forest._candidates

    def counted(*rest):
        inner = run(*rest)

        def outer(table):
            out = inner(table)
            made.add(out.num_rows)
            return out

        return outer

    monkeypatch.setattr(forest, "_candidates", counted)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = forest.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    want = brute_nearest(rows[:1600], [r for r in rows[:1600] if r[0] % 50 == 0])
    assert [(r.query_id, r.vec_id) for r in got if r.query_id < 10000] == [(q, i) for q, w in sorted(want.items()) for _, i in w]
    assert [(r.query_id, r.vec_id, r.score) for r in got if r.query_id >= 10000] == [(q, i, 1.0) for q in range(10000, 10800, 50) for i in [i for i in range(10000, 10006) if i != q][:5]]
    assert 0 < made.value < (len(want) + 16) * forest.TREES * 24, made.value


def test_forest_meets_what_one_id_hides(spark):
    """An id with very many vectors about the query does not take the places of others."""
    rng = np.random.default_rng(2)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(7, [1.0, *(1e-3 * rng.standard_normal(3)).tolist()]) for _ in range(300)] + [(i, [1.0, 0.01 * i, 0.0, 0.0]) for i in range(10, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r.vec_id for r in forest.nearest(df, df.filter("vec_id = 0")).orderBy("rank").collect()] == [7, 10, 11, 12, 13]


def test_forest_likeliest_strings():
    cost = np.array([0.5, 0.1, 0.9, 0.2])
    every = sorted(((sum(cost[list(c)]), c) for n in range(5) for c in itertools.combinations(range(4), n)))
    got = forest.likeliest(cost, 16)
    assert [round(sum(cost[list(c)]), 9) for c in got] == [round(s, 9) for s, _ in every] and len(set(map(frozenset, got))) == 16
    assert len(forest.likeliest(cost, 100)) == 16


def brute_scan(text):
    text = text or ""
    words = licenses.words_of(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    best = {}
    lines = text.split("\n")
    sets = [set(licenses.words_of(x)) for x in lines]
    at = 0
    while at < len(lines):
        if sets[at]:
            to = at
            while to + 1 < len(lines) and sets[to + 1]:
                to += 1
            sets.append(set().union(*sets[at : to + 1]))
            at = to
        at += 1
    labels = set()
    for own in sets:
        met = [(len(own & tokens) / len(tokens), label) for label, tokens in ((label, set(licenses.words_of(t))) for label, t in licenses.TEMPLATES)]
        met = [(c, label) for c, label in met if c >= licenses.THRESHOLD]
        labels |= {label for c, label in met if c == max(met)[0]}
        for c, label in met:
            best[label] = max(best.get(label, 0), c)
    base = {label for _, label in places}
    return (len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else max(best.values(), default=0.0))


def license_cases(spark):
    t = ["MIT-License, mit license! and the  MIT\nlicense", "Licensed under\nCC BY-NC 4.0.", "unlicensed under CC BY NC 4", "apache license general public license" + " pad" * 30, "xmit license", "émit license mit licenseé", "Released under the MIT", licenses.TEMPLATES[1][1].upper(), "a\n\nlicensed under cc\n\nby nc 4 0", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0", "licensed\nunder\r\nCC\nBY NC 4 0\n.\nsa"]
    return spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string")


@pytest.mark.parametrize("make", [documents, awkward, license_cases])
def test_licenses(spark, make):
    df = make(spark)
    want = sorted(((r.doc_id, *brute_scan(r.text)) for r in df.collect()), key=str)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(df).collect()), key=str)
    assert got == want
    assert licenses.scan(empty(spark)).collect() == []


def test_license_filters_drop_candidates():
    words = "rare odd seldom some plain known usual common".split()
    index = licenses.Index([("x", "rare seldom plain usual common"), ("y", "odd some known"), ("z", "rare odd seldom some")], {w: n for n, w in enumerate(words)}, 0.7)
    dropped = {}
    for block in (list(c) for n in range(9) for c in itertools.combinations(range(8), n)):
        want = [(m, len(set(block) & s) / len(s)) for m, s in enumerate(index.sets) if len(set(block) & s) >= index.overlaps[m]]
        assert index.match(block) == want
        assert {m for m, _ in want} <= set(index.candidates(block, dropped))
    assert dropped["length"] > 0 and dropped["position"] > 0
    assert index.tokens == words
    only_x = [words.index(w) for w in ("rare", "odd", "known", "common")]  # too much of the block is others' before "common" is reached
    assert index.match(only_x) == []


def brute_chat(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = []
    for c, own in convs.items():
        own.sort()
        loss = [x[3] for x in own if x[2] == "assistant"]
        out.append((c, len(own), hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest(), len("".join(loss)), hashlib.sha256("".join(loss).encode()).hexdigest()))
    return sorted(out, key=str)


def awkward_chats(spark):
    texts = ["", None, "<|im_end|>\n<|im_start|>user\nx", "\\<\\\\[", "[INST]", "é😀\n", "</s>", "{{ x }} {% if %}", "a" * 50000, "\x00\r\n"]
    rows = [(c, t, ("user", "assistant", "system", None, "odd\nrole<|", "tool\\n")[(c + t) % 6], x) for c in range(4) for t, x in enumerate(texts)]
    rows += [(None, None, "user", "x"), (None, 1, "assistant", "y"), (5, None, None, None), (5, None, None, None), (6, 1, "assistant", "b"), (6, 1, "assistant", "a"), (7, -3, "user", "late")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, formatted string").repartition(3)


@pytest.mark.parametrize("make", [awkward_chats, lambda s: s.read.parquet("/root/testdata/sf0.01/conversations.parquet")])
def test_chat(spark, make):
    df = make(spark)
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    formatted = chat.format_conversations(df)
    got = chat.digests(formatted).collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got), key=str) == brute_chat(rows)
    for r in formatted.collect():
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END.strip()) == sum(c == r.conv_id for c, *_ in rows)
        assert "[INST]" not in r.formatted and "</s>" not in r.formatted
    assert chat.digests(chat.format_conversations(df.limit(0))).collect() == []


def test_template_language():
    t = lambda source, **env: chat.Template(source).render(env.pop("messages", []), **env)[0]
    assert t("a{{ 1 + 2 * 3 }}b{{ 'x' ~ 4 }}") == "a7bx4"
    assert t("{% for m in messages %}{{ loop.index }}{{ m.a }}{{ '' if loop.last else ',' }}{% endfor %}", messages=[{"a": "p"}, {"a": "q"}]) == "1p,2q"
    assert t("{% set x = 'b' %}{% if x == 'a' %}1{% elif x in 'abc' and not x == 'c' %}2{% else %}3{% endif %}") == "2"
    assert t("{%- if y is_not -%}" if False else " {{- '  k ' | trim | upper -}} ") == "K"
    assert t("{{ m['k'][1] | escape }}{# no #}{{ missing }}", m={"k": ["", "<\\"]}) == "<\\\\\\"
    assert chat.Template("{% if 1 == 2 %}{{ x }}{% else %}a{{ 'b' * 2 }}{% endif %}c").tree == ("block", [("write", ("const", "abbc"))])
    assert chat.Template("x{% generation %}yz{% endgeneration %}").render([]) == ("xyz", [(1, 3)])
    for bad in ("{{ x", "{% if a %}", "{{ open('x') }}", "{{ a.b() }}", "{% import os %}", "{{ x | eval }}", "{{ 1 + }}", "{% for %}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    with pytest.raises(chat.TemplateError):
        t("{{ x.__class__ }}", x="s")
    with pytest.raises(chat.TemplateError):
        t("{{ raise_exception('no') }}")


def test_escapes_are_reversible():
    for n in range(6):
        for chars in itertools.product("\\<[n\n|", repeat=n):
            s = "".join(chars)
            assert chat.unescape(chat.escape(s)) == s and chat.unescape_role(chat.escape_role(s)) == s
            assert "<|" not in chat.escape(s) and "\n" not in chat.escape_role(s)
