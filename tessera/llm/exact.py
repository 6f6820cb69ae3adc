"""Exact dedup by progressive refinement, in DataFrame operations only.

Texts are grouped by length; of those with company, the prefix is hashed; of those
with company in length and prefix, the whole text. What has company is told to the
next scan by a filter of at most SLOTS slots (a slot holds all keys of one hash
remainder), so its size is bounded whatever the data, it may be broadcast, and a
false hit costs one more hash and nothing else. Texts are scanned once for each of the
three and never shuffled: the last scan writes ids, lengths and hashes, and groups, as
well as the way back to the rows, are made of these. Groups are counted with map-side sums, and the join that brings
a group's result back to its rows is one that the planner splits where a group is hot.

Defined results: null counts as the empty text; a null doc_id is smaller than any
other; rows that repeat both doc_id and text share one verdict; an empty table
gives an empty result; other columns are not looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settle, tune

PREFIX, SLOTS = 128, 1 << 18


def _with_company(rows: DataFrame, keys: list[str], hit: str) -> DataFrame:
    """The filter's slots for keys that more than one row has: at most SLOTS rows."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int").alias("slot")
    return F.broadcast(rows.groupBy(*keys).count().filter("count > 1").select(slot).distinct().withColumn(hit, F.lit(True)))


def _told(rows: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")).join(slots, "slot", "left").drop("slot")


def _digest(text: Column) -> Column:
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def exact_dedup(docs: DataFrame, prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """Of texts that are identical after lower-casing A-Z, the row with the largest doc_id stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256 (null for texts whose full
    content was not needed, unless digest_all) and text_hash (64 bits of the text as it
    stands, null like 42, to tell rows of one doc_id apart)."""
    tune(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).withColumn("len", F.octet_length("text"))
    by_length = _told(base, _with_company(base.select("len"), ["len"], "hit_len"), ["len"])
    head = by_length.withColumn("pre", F.when(F.col("hit_len"), F.xxhash64(ascii_lower(F.substring("text", 1, prefix)))))
    by_prefix = _told(head, _with_company(head.filter("hit_len").select("len", "pre"), ["len", "pre"], "hit_pre"), ["len", "pre"])
    wanted = F.lit(True) if digest_all else F.coalesce(F.col("hit_pre"), F.lit(False))
    rows = settle(by_prefix.select("doc_id", "text_hash", "len", "pre", "hit_pre", F.when(wanted, _digest(F.col("text"))).alias("text_sha256")))
    groups = rows.filter("hit_pre").groupBy("len", "pre", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = groups.select(F.col("text_sha256").alias("key"), "keep_id", "group_size", F.lit(True).alias("met"))
    keyed = rows.withColumn("key", F.coalesce("text_sha256", F.concat(F.lit("-"), F.coalesce("doc_id", F.lit(0)), F.lit("-"), "len")))
    joined = keyed.join(groups, "key", "left").select("doc_id", F.when(F.col("met"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256", "text_hash")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "text_hash")


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
