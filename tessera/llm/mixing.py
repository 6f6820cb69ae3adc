"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame
operations only.

A document of a source whose target is r times its size gets floor(r) copies and,
with probability r - floor(r), one more. The fractions are settled by the pivotal
method: two documents duel, mass moves from one to the other until one is integral
(in or out), the other carries the residual into the next duel. Duels run in a
reduction tree: cells of a source's documents of like size (about CELL each, sorted
by size, so that mass moves between neighbours in size) settle all but one each,
the residuals meet in cells of FAN cells, then of a whole size class, then across
the size classes of a source; the last one is drawn. A cell is the only thing that
a task gathers. Cells are cut by a hash of doc_id and text as finely as the whole
table asks for, so a source with a third of all rows has many, and all random
numbers are hashes, so reruns agree.

Defined results: a null text has size 0; a null source is a source, last in order;
a null doc_id is a document; repeated rows are documents of their own, told apart by a
number within their doc_id, source and text (so they stand in cells of their own); an empty
table gives an empty result."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_words, settle, tune

CELL, FAN_BITS, MOST_COPIES, HASH_BITS, CHUNK = 64, 7, 3, 40, 1 << 16
#: Source totals up to this many rows are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 10_000
_DECIDED = "array<struct<size:bigint,h:bigint,doc_id:bigint,text_hash:bigint,p:double,extra:int>>"


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _duels(units: Column, seed: int) -> Column:
    """Units (structs of size, h, doc_id, p) in order: all but one decided; the last element is the residual, with extra null."""

    def duel(acc: Column, x: Column) -> Column:
        res = acc["res"]
        total = res["p"] + x["p"]
        wins = _uniform(F.lit(seed), res["doc_id"], res["h"], x["doc_id"], x["h"]) < F.when(total < 1, x["p"] / F.when(total > 0, total)).otherwise((1 - res["p"]) / (2 - total))
        goes_on = F.coalesce(wins, F.lit(True)) == (total < 1)
        who = lambda y, p, extra: F.struct(y["size"].alias("size"), y["h"].alias("h"), y["doc_id"].alias("doc_id"), y["text_hash"].alias("text_hash"), p.alias("p"), extra.alias("extra"))
        none, rest = F.lit(None).cast("int"), F.when(total < 1, total).otherwise(total - 1)
        done = F.when(total < 1, F.lit(0)).otherwise(F.lit(1))
        return F.struct(
            F.when(goes_on, who(x, rest, none)).otherwise(who(res, rest, none)).alias("res"),
            F.concat(acc["out"], F.array(F.when(goes_on, who(res, F.lit(0.0), done)).otherwise(who(x, F.lit(0.0), done)))).alias("out"),
        )

    first = units[0]
    start = F.struct(F.struct(first["size"].alias("size"), first["h"].alias("h"), first["doc_id"].alias("doc_id"), first["text_hash"].alias("text_hash"), first["p"].alias("p"), F.lit(None).cast("int").alias("extra")).alias("res"), F.array().cast(_DECIDED).alias("out"))
    return F.aggregate(F.slice(units, F.lit(2), F.size(units)), start, duel, lambda acc: F.concat(acc["out"], F.array(acc["res"])))


def _round(units: DataFrame, keys: list[Column], seed: int, order: tuple[str, ...]) -> DataFrame:
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    unit = F.struct(*order, *[c for c in ("size", "h", "doc_id", "text_hash", "p") if c not in order])
    cells = units.groupBy(*named).agg(F.array_sort(F.collect_list(unit)).alias("units"))
    flat = F.transform("units", lambda u: F.struct(u["size"].alias("size"), u["h"].alias("h"), u["doc_id"].alias("doc_id"), u["text_hash"].alias("text_hash"), u["p"].alias("p")))
    cells = cells.select(*[f"k{i}" for i in range(len(keys))], flat.alias("units"))
    return settle(cells.select(F.col("k0").alias("source"), F.explode(_duels(F.col("units"), seed)).alias("u")).select("source", "u.*").withColumn("cls", _size_class(F.col("size"))))


def _size_class(size: Column) -> Column:
    return F.floor(4 * F.log2(size + 1)).cast("int")


def targets(sized: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3, repeating by code point of the source, null last, share all
    sizes; what exceeds most times a source's size is reshared. One row a source, however many there are: sources are
    numbered by range partitions, and each round of resharing is a sum over the table."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = settle(ordered.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)).withColumn("at", F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("id"))
    before, offsets = 0, []
    for r in placed.groupBy("part").count().orderBy("part").collect():  # one number for each partition
        offsets.append((r.part, before))
        before += r["count"]
    numbered = placed.join(F.broadcast(spark.createDataFrame(offsets, "part long, offset long")), "part")
    weighed = numbered.select("source", "source_size", (1 + F.pmod(F.col("at") + F.col("offset"), F.lit(3))).cast("double").alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    total, weights = weighed.agg(F.sum("source_size").cast("double"), F.sum("w")).first()
    level, n = (total or 0.0) / (weights or 1.0), -1
    while True:
        full = F.col("cap") <= F.col("w") * level
        taken, left, now = weighed.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w"))), F.count(F.when(full, 1))).first()
        if now == n:
            break
        level, n = (total - (taken or 0.0)) / left if left else level, now
    return weighed.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def numbered(sized: DataFrame) -> DataFrame:
    """Rows with a number (rn) that tells equal ones apart. Equal rows are counted, and their numbers made again by
    tasks of at most CHUNK, so that no task gathers them."""
    keys = sized.columns
    chunks = sized.groupBy(*keys).count().withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {CHUNK}")))).repartition(*keys, "chunk")
    last = F.least(F.lit(CHUNK - 1).cast("long"), F.col("count") - 1 - F.col("chunk") * CHUNK)
    return chunks.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(*keys, (F.col("at") + F.col("chunk") * CHUNK).alias("rn"))


def mix(docs: DataFrame, seed: int = 17, most: float = MOST_COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), copies (0 to most), taken (copies x size) and text_hash."""
    tune(docs.sparkSession)
    sized = settle(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_words(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))))
    goals = settle(targets(sized, most)).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goals = goals.withColumn("base", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    named = goals.withColumnRenamed("source", "goal_source")
    aimed = sized.join(named, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    units = aimed.filter("p > 0").select("source", "size", F.pmod(F.when(F.col("rn") == 0, F.xxhash64(F.lit(seed), "doc_id", "text_hash")).otherwise(F.xxhash64(F.lit(seed), "doc_id", "text_hash", "rn")), F.lit(1 << HASH_BITS)).alias("h"), "doc_id", "text_hash", "p").withColumn("cls", _size_class(F.col("size")))
    bits = max(0, math.ceil(math.log2(max(1, sized.count()) / CELL)))
    settled, live = [], units
    while True:
        cell = F.shiftright("h", HASH_BITS - bits) if bits else F.lit(0).cast("long")
        step = _round(live, [F.col("source"), F.col("cls"), cell], seed, ("size",))
        settled.append(step.filter("extra is not null"))
        live = step.filter("extra is null")
        if not bits:
            break
        bits = max(0, bits - FAN_BITS)
    step = _round(live, [F.col("source")], seed, ("cls", "size"))  # a residual for each size class
    settled += [step.filter("extra is not null"), step.filter("extra is null").withColumn("extra", (_uniform(F.lit(seed), F.col("doc_id"), F.col("h")) < F.col("p")).cast("int"))]
    extra = settled[0]
    for more in settled[1:]:
        extra = extra.union(more)
    decided = extra.select("source", "doc_id", "text_hash", "size", "extra").join(named, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    plain = aimed.filter("p <= 0").select("source", "doc_id", "text_hash", "size", F.lit(0).alias("extra"), "source_size", "target", "rate", "base", "p")
    return decided.select(plain.columns).union(plain).select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("extra")).alias("copies"), ((F.col("base") + F.col("extra")) * F.col("size")).alias("taken"), "text_hash")
