import hashlib

from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import bpe, mixing, registry, simhash, toxicity

from .test_dedup import brute_components
from .util import awkward, documents, empty

SF = "/root/testdata/sf0.001"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    words = low(text).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_on_documents(spark):
    docs = documents(spark)
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = P.toxicity_stage(spark, docs, SF)
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.learn(docs, labels)).filter("predicted = 1").collect()}
    rows = [r for r in docs.collect() if r.doc_id not in bad]
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in rows}
    two = P.exact_stage(spark, one, SF)
    best = {}
    for r in rows:
        best[low(r.text)] = max(best.get(low(r.text), -1), r.doc_id)
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(best.values())
    three = P.near_stage(spark, two, SF)
    assert three.columns == columns
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in two.collect()}
    kept = {r.doc_id for r in three.collect()}
    shingles = {r.doc_id: shingle_set(r.text) for r in two.collect()}
    alike = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2 or len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) > 0
    assert kept == set(brute_components(sorted(fps), alike).values())
    four = P.mixing_stage(spark, three, SF)
    counts = {}
    for r in four.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert four.columns == columns and counts == {r.doc_id: r.copies for r in mixing.mix(three).collect() if r.copies}
    five = P.encoding_stage(spark, four, SF)
    text = {r.doc_id: r.text for r in four.collect()}
    got = five.collect()
    assert len(got) == sum(counts.values())
    assert all(r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest() and len(r.ids) == r.n_tokens for r in got)
    assert sorted((r.doc_id, r.ids_sha256) for r in P.run(spark, SF).collect()) == sorted((r.doc_id, r.ids_sha256) for r in got)


def test_stages_whatever_columns_are_named(spark):
    names = ["predicted", "row", "key", "_row_hash", "_copies", "copies", "own", "gone", "i", "n", "we ird.`name"]
    docs = documents(spark).filter("doc_id < 60")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        for r in out.limit(5).collect():
            assert list(r)[-len(names) :] == list(range(len(names)))


def test_mixing_stage_takes_repeated_rows_by_their_share(spark):
    rows = [(1, "five words are in this", "en", "a", 22)] * 400 + [(i, "w " * 2, "en", "b", 4) for i in range(2, 1000)]
    docs = spark.createDataFrame(rows, documents(spark).schema).repartition(4)
    want = sum(r.copies for r in mixing.mix(docs).filter("doc_id = 1").collect())
    assert P.mixing_stage(spark, docs, SF).filter("doc_id = 1").count() == want


def test_registered_queries_keep_to_their_contract(spark):
    want = {
        "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
        "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
        "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op4_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
        "op5_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op6_token_counts": "doc_id bigint, n_units bigint, n_tokens bigint",
        "op7_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op8_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
        "op9_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
        "op10_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    }
    rows = documents(spark).count()
    assert set(registry.QUERIES) == {*want, "pipeline"}
    for name, columns in want.items():
        out = registry.QUERIES[name](spark, SF)
        assert dict(out.dtypes).items() >= dict(c.split(" ") for c in columns.split(", ")).items(), name
        assert name in ("op8_nearest_neighbours", "op10_chat_format") or out.count() == rows, name
    said = "</s>[INST] ok [/INST]"
    own = registry.QUERIES["op10_chat_format"](spark, SF).filter("conv_id = -1").first()
    assert own.n_turns == 2 and own.loss_chars == len(said) and own.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_stages_on_awkward_rows(spark):
    for make in (awkward, empty):
        docs = make(spark)
        sizes = [docs.count()]
        for _, stage in P.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
            sizes.append(docs.count())
            assert len(docs.columns) == 10
        assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count()
        assert sizes[:4] == sorted(sizes[:4], reverse=True)
    assert bpe.encode(docs).columns[0] == "doc_id"
