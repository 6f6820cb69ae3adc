"""The queries of this subpackage, their SQL where it can express them, and the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, chat, exact, forest, licenses, mixing, simhash, substring, toxicity, unigram
from .common import table


def op1_substring_dedup(spark, sf_dir):
    return substring.substring_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text", "spans")


def op2_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).drop("fp", "text_hash", "root")


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op4_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True).drop("text_hash")


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "text_hash")


def op6_token_counts(spark, sf_dir):
    return unigram.token_counts(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), with_ids=False)


def op8_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op9_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op10_chat_format(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(table(spark, sf_dir, "conversations").select(more.columns).union(more)))


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_simhash, op3_toxicity, op4_exact_dedup, op5_mixing, op6_token_counts, op7_byte_bpe, op8_nearest_neighbours, op9_license_scan, op10_chat_format)
} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {"op4_exact_dedup": exact.EXACT_SQL}
