"""A corpus pipeline: toxicity, exact dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
Its result is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents, whatever others docs has and however they are
named: a row travels as one struct. A stage decides on narrow rows; texts meet the
decision in one join on doc_id and a hash of the text.

Defined results: a null text is a text (in exact dedup equal to the empty one), a null
doc_id is a document; rows that repeat a doc_id are told apart by their texts; where both
repeat, the dedup stages keep one such row (the least by the other columns), toxicity and
mixing take them as rows of their own; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact, mixing, near, toxicity
from tessera.llm.common import settle, table


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns as one) and key (doc_id and a hash of the text; struct fields may be null and still be equal)."""
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return docs.select(whole.alias("row"), _key(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))


def _key(doc_id, text_hash):
    return F.struct(doc_id.alias("doc_id"), text_hash.alias("text_hash")).alias("key")


def _rows(keyed: DataFrame, docs: DataFrame) -> DataFrame:
    return keyed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _keep(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose doc_id and text_hash are not in dropped, one of each doc_id and text (of rows that repeat both, the least by the other columns)."""
    told = _keyed(docs)
    again = told.groupBy("key").count().filter("count > 1").select("key", F.lit(False).alias("gone"))
    gone = dropped.select(_key(F.col("doc_id"), F.col("text_hash")), F.lit(True).alias("gone"))
    known = told.join(again.union(gone).groupBy("key").agg(F.max("gone").alias("gone")), "key", "left")
    once = known.filter("gone is null").select("row")
    return _rows(once.union(known.filter("not gone").groupBy("key").agg(F.min("row").alias("row")).select("row")), docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the grammar, learned from the labels of these documents, predicts as toxic."""
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays; of several rows with that doc_id, one."""
    groups = settle(exact.exact_dedup(docs).filter("group_size > 1").select("doc_id", "text_hash", "text_sha256", "kept"))
    best = groups.filter("kept").groupBy("text_sha256").agg(F.min("text_hash").alias("best"))
    return _keep(docs, groups.join(best, "text_sha256").filter("not kept or text_hash <> best"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five-word shingles, or by op2's fingerprints, the one with the smallest doc_id stays (a null one if there is no other)."""
    groups = near.near_groups(docs)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
    return _keep(docs, groups.join(best, "root").filter(other))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0 to 3 times. Rows of equal doc_id, text and source are taken as often as all of them together, in the shape of the least by the other columns."""
    key = F.struct(F.col("doc_id"), F.col("text_hash"), F.col("source")).alias("key")
    taken = mixing.mix(docs).groupBy(key).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    told = _keyed(docs).select("row", F.struct(F.col("key.doc_id"), F.col("key.text_hash"), F.col("row").getField("source").cast("string").alias("source")).alias("key"))
    single = told.join(taken.filter("n = 1 and copies > 0"), "key").select("row", F.col("copies").cast("int").alias("own"))
    several = told.join(taken.filter("n > 1 and copies > 0"), "key").groupBy("key").agg(F.min("row").alias("row"), F.max("copies").alias("copies"))
    several = several.withColumn("chunk", F.explode(F.expr("sequence(0L, (copies - 1) div 65536)"))).repartition("key", "chunk")
    several = several.withColumn("i", F.explode(F.expr("sequence(0L, least(65535L, copies - 1 - chunk * 65536))"))).select("row", F.lit(1).alias("own"))
    return _rows(single.union(several).withColumn("own", F.explode(F.array_repeat(F.lit(1), F.col("own")))), docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digests; the digest of the decoded bytes proves the round trip."""
    return bpe.encode(docs)


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("byte_bpe", encoding_stage)]

#: No SQL: stages learn a model, hash with XXH64 and draw at random; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
