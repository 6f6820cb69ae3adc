"""Joins, aggregates, layout and streams against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera import functions, operators, streaming
from tessera.plans import layout


def boxes(spark, n, seed, name, wide=30.0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = r.uniform(-200, 200), r.uniform(-200, 200)
        size = 10 ** r.uniform(-2, 2) if i % 9 else 350.0  # sizes over four orders, some of which cover nearly all
        rows.append((i, x, y, x + size * r.random(), y + size * r.random()))
    rows += [(n, 0.0, 0.0, 0.0, 0.0), (n + 1, None, None, None, None)]
    functions.register(spark)
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, d double")
    return rows, df.selectExpr(f"i AS {name}", f"IF(a IS NULL, NULL, st_box2d(a, b, c, d)) AS {name}_box", f"st_makeenvelope(a, b, c, d) AS {name}_geom")


def meet(p, q):
    return None not in (p[1], q[1]) and p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]


@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti"])
def test_bounds_join(spark, how):
    p, left = boxes(spark, 120, 1, "l")
    q, right = boxes(spark, 90, 2, "r")
    pairs = {(x[0], y[0]) for x in p for y in q if meet(x, y)}
    got = operators.spatial_join(left, right, "l_box", "r_box", "bounds", how=how)
    if how == "inner":
        rows = [(r.l, r.r) for r in got.select("l", "r").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == pairs
    elif how == "left":
        assert sorted(((r.l, r.r) for r in got.select("l", "r").collect()), key=str) == sorted([*pairs, *((x[0], None) for x in p if x[0] not in {a for a, _ in pairs})], key=str)
    else:
        met = {a for a, _ in pairs}
        assert sorted(r.l for r in got.select("l").collect()) == sorted(x[0] for x in p if (x[0] in met) == (how == "semi"))


@pytest.mark.parametrize("predicate", ["intersects", "contains", "within", "touches", "covers", "equals"])
def test_predicate_join(spark, predicate):
    left = boxes(spark, 60, 3, "l")[1].filter("l < 60")  # without the box of no area, which is no valid polygon
    right = boxes(spark, 50, 4, "r")[1].filter("r < 50")
    got = operators.spatial_join(left, right, "l_geom", "r_geom", predicate).select("l", "r")
    want = left.crossJoin(right).filter(f"st_{predicate}(l_geom, r_geom)").select("l", "r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_join_plan_is_an_equi_join(spark):
    _, left = boxes(spark, 30, 5, "l")
    _, right = boxes(spark, 30, 6, "r")
    plan = operators.spatial_join(left, right, "l_box", "r_box", "bounds")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        operators.spatial_join(left, right, "l_box", "r_box", "bounds", how="full")
    assert operators.spatial_join(left.limit(0), right, "l_box", "r_box", "bounds").count() == 0


def test_knn_join(spark):
    functions.register(spark)
    r = random.Random(7)
    a = [(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(20)]
    b = [(i, float(r.randint(0, 100)), float(r.randint(0, 100))) for i in range(200)]
    df = lambda rows, n: spark.createDataFrame(rows, f"{n} long, x double, y double").selectExpr(n, f"st_point2d(x, y) AS {n}p")
    got = operators.knn_join(df(a, "a"), df(b, "b"), "a", "b", "ap", "bp", 4, 1.0)
    want = {(i, k + 1, j) for i, x, y in a for k, (_, j) in enumerate(sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, u, v in b)[:4])}
    assert {(x.a, x["rank"], x.b) for x in got.collect()} == want


def test_aggregates(spark):
    functions.register(spark)
    df = spark.sql("SELECT id % 3 AS k, st_makeenvelope(id * 0.5D, 0D, id * 0.5D + 1, 1D) AS g, st_point2d(id * 1D, 0D) AS p, id FROM range(3000)").union(spark.sql("SELECT 9L, CAST(NULL AS BINARY), NULL, 0L"))
    area = {r.k: r.a for r in operators.union_agg(df, ["k"], "g", "u").selectExpr("k", "st_area(u) AS a").collect()}
    assert area == {0: 1000.0, 1: 1000.0, 2: 1000.0}  # a group of 1000 is folded in parts
    from tessera.operators.aggregates import extent_of

    found = {r.k: r.t for r in extent_of(df, ["k"], "g").selectExpr("k", "st_astext(extent) AS t").collect()}
    assert found[9] is None and found[0] == "POLYGON ((0 0, 0 1, 1499.5 1, 1499.5 0, 0 0))"
    lines = {r.k: r.n for r in operators.makeline_agg(df.filter("id < 30 AND k < 9"), ["k"], "p", "id", "l").selectExpr("k", "st_length_linestring2d(l) AS n").collect()}
    assert lines == {0: 27.0, 1: 27.0, 2: 27.0}
    assert operators.collect_agg(df.filter("id < 6 AND k < 9"), ["k"], "g", "c").selectExpr("st_ngeometries(c) AS n").distinct().first()["n"] == 2


def test_layout_prunes(spark, tmp_path):
    _, df = boxes(spark, 2000, 8, "l")
    path = str(tmp_path / "clustered")
    layout.write_clustered(df, "l_box", path, 8)
    back = spark.read.parquet(path)
    window = layout.window(back, (-20.0, -20.0, 20.0, 20.0))
    want = df.filter("l_box.min_x <= 20 AND l_box.max_x >= -20 AND l_box.min_y <= 20 AND l_box.max_y >= -20")
    assert sorted(r.l for r in window.select("l").collect()) == sorted(r.l for r in want.select("l").collect())
    assert "PushedFilters: [IsNotNull(bbox" in window._jdf.queryExecution().executedPlan().toString()
    assert layout.index_info(back).agg(F.sum("rows")).first()[0] == df.count()


def test_stream_equals_batch(spark, tmp_path):
    functions.register(spark)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("ts", "CAST(user_id % 64 AS DOUBLE) AS x", "CAST(event_id % 64 AS DOUBLE) AS y")
    path = str(tmp_path / "events")
    events.repartition(3).write.parquet(path)
    counted = streaming.tile_counts(spark.readStream.schema(events.schema).parquet(path), "ts", "x", "y", 4)
    query = counted.writeStream.outputMode("complete").format("memory").queryName("tiles").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        got = {tuple(r) for r in spark.sql("SELECT * FROM tiles").collect()}
    finally:
        query.stop()
    batch = streaming.tile_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "x", "y", 4)
    assert got == {tuple(r) for r in batch.collect()}


def test_knn_join_nulls_outliers_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    left = [(1, 0.0, 0.0), (2, None, 1.0), (3, 1e6, 1e6), (4, nan, 0.0), (5, inf, 0.0), (6, 5.0, 5.0), (6, 50.0, 50.0)]
    right = [(10, 0.0, 1.0), (11, None, None), (12, 1.0, 0.0), (13, -2e5, 3.0), (12, 9.0, 9.0)]
    frame = lambda rows, i, p: spark.createDataFrame([(k, None if x is None else (x, y)) for k, x, y in rows], f"{i} long, {p} struct<x:double,y:double>")
    run = lambda a, b, k: sorted((r.a, r.b, r["rank"]) for r in operators.knn_join(a, b, "a", "b", "ap", "bp", k, 1.0).collect())
    a, b = frame(left, "a", "ap"), frame(right, "b", "bp")
    assert run(a, b, 2) == [(1, 10, 1), (1, 12, 2), (3, 10, 2), (3, 12, 1), (6, 10, 2), (6, 12, 1), (6, 12, 1), (6, 12, 2)]
    assert len(run(a, b, 9)) == 4 * 4  # fewer than k: all of them
    assert run(a, b.filter("b = 11"), 2) == run(a.filter("a = 2"), b, 2) == []


def test_outer_joins_of_rows_in_no_order(spark):
    left = spark.range(400).selectExpr("id", "st_point2d(CAST(id % 20 AS DOUBLE), CAST(id DIV 20 AS DOUBLE)) AS p").repartition(7)
    right = spark.sql("SELECT 1 AS r, st_box2d(-0.5D, -0.5D, 4.5D, 3.5D) AS b")
    for how, n in (("left", 400), ("semi", 20), ("anti", 380)):
        assert operators.spatial_join(left, right, "p", "b", "bounds", how=how).select("id").distinct().count() == n


def shuffled_mb(spark, run):
    """What run() writes to shuffles."""
    executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)
    total = lambda: sum(executors().apply(i).totalShuffleWrite() for i in range(executors().size())) / 1e6
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


def most_joined(spark, run):
    """The most rows that a join made while run() ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda s: [s.apply(i) for i in range(s.size())]
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = [0]
    for e in listed(store.executionsList())[before:]:
        values = store.executionMetrics(e.executionId())
        for node in listed(store.planGraph(e.executionId()).allNodes()):
            if "Join" in node.name():
                made += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in listed(node.metrics()) if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return max(made)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_pairs_of_copies_are_not_shuffled(spark, how):
    """Copies of one point meet copies of one box: four million pairs, in one cell."""
    functions.register(spark)
    left = spark.range(2000).selectExpr("id AS l", "IF(id = 7, NULL, st_point2d(1D, 1D)) AS p")
    right = spark.range(2000).selectExpr("id AS r", "st_box2d(0D, 0D, 2D, 2D) AS b")
    found = []
    mb = shuffled_mb(spark, lambda: found.extend(operators.spatial_join(left, right, "p", "b", "bounds", how=how).agg(F.count("*"), F.count_distinct("l"), F.sum("r"), F.count("r")).first()))
    assert found == [1999 * 2000 + (how == "left"), 1999 + (how == "left"), 1999 * 1999 * 1000, 1999 * 2000]
    assert mb < 8


@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti"])
def test_join_by_other_columns_too(spark, how):
    p, left = boxes(spark, 60, 11, "l")
    q, right = boxes(spark, 60, 12, "r")
    left, right = (df.union(df.filter(f"{n} < 20")) for df, n in ((left, "l"), (right, "r")))  # rows that repeat
    p, q = p + p[:20], q + q[:20]
    pairs = [(x[0], y[0]) for x in p for y in q if meet(x, y) and (x[0] + y[0]) % 3 == 0]
    got = operators.spatial_join(left, right, "l_box", "r_box", F.expr("st_intersects_box2d(l_box, r_box) AND (l + r) % 3 = 0"), how=how)
    met = {a for a, _ in pairs}
    want = {"inner": pairs, "left": pairs + [(x[0], None) for x in p if x[0] not in met], "semi": [(x[0],) for x in p if x[0] in met], "anti": [(x[0],) for x in p if x[0] not in met]}[how]
    assert sorted(map(tuple, got.select("l", *["r"] * (how in ("inner", "left"))).collect()), key=str) == sorted(want, key=str)


def test_measures_and_counts_of_pairs(spark):
    functions.register(spark)
    left = spark.range(300).selectExpr("id AS l", "st_makeenvelope(id % 3, 0D, id % 3 + 1.5D, 1D) AS g")
    right = spark.range(400).selectExpr("id AS r", "st_makeenvelope(id % 2, 0D, id % 2 + 1D, 1D) AS h")
    area = lambda a, b: max(0.0, min(a % 3 + 1.5, b % 2 + 1.0) - max(a % 3, b % 2))
    meets = lambda a, b: min(a % 3 + 1.5, b % 2 + 1.0) >= max(a % 3, b % 2)
    got = operators.spatial_join(left, right, "g", "h", "intersects", measures={"area": F.call_function("st_area", F.call_function("st_intersection", "g", "h"))})
    assert got.columns == ["l", "g", "r", "h", "area"]
    assert sorted((r.l, r.r, r.area) for r in got.collect()) == [(a, b, area(a, b)) for a in range(300) for b in range(400) if meets(a, b)]
    counts = operators.match_counts(left, right, "g", "h").selectExpr("st_xmin(g) AS x", "n").collect()
    assert {r.x: r.n for r in counts} == {x: n for x in range(3) if (n := sum(meets(x, b) for b in range(400)))}
    with pytest.raises(ValueError):
        operators.spatial_join(left, right, "g", "h", how="left", measures={"one": F.lit(1)})


def test_knn_join_of_copies(spark):
    """Rows at few places: a table of all pairs in reach would have millions of rows."""
    functions.register(spark)
    left = spark.range(3000).selectExpr("id AS a", "st_point2d(CAST(id % 7 AS DOUBLE), 0.25D) AS ap")
    right = spark.range(3000).selectExpr("3000 - id AS b", "st_point2d(CAST(id % 5 AS DOUBLE), 0D) AS bp")
    found = []
    made = most_joined(spark, lambda: found.extend(map(tuple, operators.knn_join(left, right, "a", "b", "ap", "bp", 3, 4.0).select("a", "rank", "b").collect())))
    near = {x: sorted((((x - (3000 - j) % 5) ** 2 + 0.0625) ** 0.5, j) for j in range(1, 3001))[:3] for x in range(7)}
    assert sorted(found) == [(i, k, j) for i in range(3000) for k, (_, j) in enumerate(near[i % 7], 1)]
    assert made <= 9000


def test_joins_meet_different_geometries(spark):
    functions.register(spark)
    left = spark.range(2000).selectExpr("id AS l", "st_makeenvelope(id % 2, 0D, id % 2 + 1, 1D) AS g")
    right = spark.range(2000).selectExpr("id AS r", "st_makeenvelope(id % 3, 0D, id % 3 + 1, 1D) AS h")
    n = []
    assert most_joined(spark, lambda: n.append(operators.spatial_join(left, right, "g", "h").count())) <= 2000
    assert n == [sum(abs(a % 2 - b % 3) < 2 for a in range(2000) for b in range(2000))]


def test_sql_aggregates_of_many_rows(spark):
    """Many copies of different squares: what is folded does not grow with the copies."""
    functions.register(spark)
    spark.range(160_000).selectExpr("st_makeenvelope(id % 4000 * 2D, 0D, id % 4000 * 2D + 1, 1D) AS g", "st_makeenvelope(-1D - id % 4000, 0D, 1D, 1D + id % 4000) AS w").createOrReplaceTempView("squares")
    began = time.perf_counter()
    got = spark.sql("SELECT st_area(st_union_agg(g)) AS u, st_ngeometries(st_union_agg(g)) AS n, st_area(st_intersection_agg(w)) AS i FROM squares").first()
    assert tuple(got) == (4000.0, 4000, 2.0)
    assert time.perf_counter() - began < 40
    assert spark.sql("SELECT st_union_agg(CAST(NULL AS BINARY)) AS u FROM squares").first().u is None
