"""Spatial joins as equi-joins over grid cells.

Spark has no range join, so a spatial predicate by itself plans a nested loop. Here
rows of one geometry are packed (BLOCK rows to an array at most, about), so that what
is laid out, met and tested are different geometries, and rows come back last, inside
the task that met them: no row of a pair is shuffled. Each geometry's bounds are laid
over a grid, geometries meet on the cell (a sort-merge join), bounds are compared
exactly, a pair is kept in the one cell that holds the lower corner of the bounds'
overlap, and the exact predicate runs last. Rows whose bounds cover more than MOST_CELLS
cells go to coarser grids, by powers of 8, and each level meets each other level. Cells
with more than their share of the pairs are cut on both sides."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import register
from ..shared import drop, settle

MOST_CELLS, STEP, BLOCK = 16, 8, 128
#: Pairs of rows from which on a cell may be cut.
LEAST_CUT = 1 << 20
BOUNDED = ("equals", "intersects", "touches", "crosses", "within", "contains", "overlaps", "covers", "coveredby", "containsproperly")


def bounds_of(df: DataFrame, geom: str) -> Column:
    """The bounds of a column by its type: POINT_2D, BOX_2D, LINESTRING_2D, POLYGON_2D or GEOMETRY."""
    kind, c = df.schema[geom].dataType.simpleString(), F.col(geom)
    if kind.startswith("struct<x:"):
        return F.struct(c["x"].alias("min_x"), c["y"].alias("min_y"), c["x"].alias("max_x"), c["y"].alias("max_y"))
    if kind.startswith("struct<min_x:"):
        return c
    if kind.startswith("array<struct"):
        return F.call_function("st_extent_linestring2d", c)
    if kind.startswith("array<array"):
        return F.call_function("st_extent_polygon2d", c)
    return F.call_function("st_extent", c)


def _level(box: Column, cell: float) -> Column:
    """The grid's level on which a box covers at most MOST_CELLS cells (a power of STEP of the cell size)."""
    wide = F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]) / (cell * (math.isqrt(MOST_CELLS) - 1))
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(wide, F.lit(1e-300))) / math.log(STEP))).cast("int")


def _kept(column: str) -> Column:
    """Whether bounds are those of something: neither null nor of an empty point."""
    return F.col(column).isNotNull() & ~F.isnan(F.col(column)["min_x"])


def _grown(df: DataFrame, geom: str, out: str, distance: float = 0.0) -> DataFrame:
    """Rows that have bounds, with these (grown by distance) as a column."""
    b = bounds_of(df, geom)
    return df.withColumn(out, F.when(b.isNotNull(), F.struct((b["min_x"] - distance).alias("min_x"), (b["min_y"] - distance).alias("min_y"), (b["max_x"] + distance).alias("max_x"), (b["max_y"] + distance).alias("max_y")))).filter(_kept(out))


def _packed(df: DataFrame, geom: str, counted: DataFrame, out: str) -> DataFrame:
    """A row for each geometry and BLOCK of its rows (about), which are the array out of structs of the other columns."""
    others = [c for c in df.columns if c != geom]
    # rows of a geometry are dealt by their content, so that a task that runs again deals them alike; at most one in BLOCK rows is counted here
    many = counted.filter(F.col("_n") > BLOCK).select(F.col(geom), F.ceil(F.col("_n") / BLOCK).alias("_blocks"))
    dealt = F.pmod(F.xxhash64(*others), F.coalesce("_blocks", F.lit(1))) if others else F.lit(0)
    rows = F.collect_list(F.struct(*others) if others else F.struct(F.lit(True).alias("_one")))
    return df.filter(F.col(geom).isNotNull()).join(F.broadcast(many), geom, "left").groupBy(geom, dealt.alias("_block")).agg(rows.alias(out)).drop("_block")


class _Sides:
    """Both sides' different geometries with the numbers of their rows (tables of their own), and the grid over them."""

    def __init__(self, left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, predicate: str | Column, distance: float, cell: float | None) -> None:
        if not isinstance(predicate, Column) and predicate not in (*BOUNDED, "dwithin", "bounds"):
            raise ValueError(f"no predicate {predicate!r}")
        self.left_geom, self.right_geom, self.predicate, self.distance = left_geom, right_geom, predicate, distance
        self.plain = False
        if isinstance(predicate, Column):
            try:
                left.select(left_geom).join(right.select(right_geom), predicate).schema  # noqa: B018
            except AnalysisException:
                self.plain = True  # the predicate reads other columns too, so that rows are what is tested
        if self.plain:
            self.a, self.b = (settle(_grown(df.withColumn("_n", F.lit(1).cast("long")), g, c, d)) for df, g, c, d in ((left, left_geom, "_lb", distance), (right, right_geom, "_rb", 0.0)))
        else:
            self.a, self.b = (settle(_grown(df.groupBy(g).agg(F.count("*").alias("_n")), g, c, d)) for df, g, c, d in ((left, left_geom, "_lb", distance), (right, right_geom, "_rb", 0.0)))
        # typical extents and the levels in use: a handful of numbers, by one aggregate each
        wide = lambda df, c: df.agg(F.avg(F.greatest(F.col(c)["max_x"] - F.col(c)["min_x"], F.col(c)["max_y"] - F.col(c)["min_y"])).alias("w"), F.count("*").alias("n"), F.min(F.col(c)["min_x"]).alias("x0"), F.max(F.col(c)["max_x"]).alias("x1"), F.min(F.col(c)["min_y"]).alias("y0"), F.max(F.col(c)["max_y"]).alias("y1")).first()
        if cell is None:
            sa, sb = wide(self.a, "_lb"), wide(self.b, "_rb")
            if not sa.n or not sb.n:
                cell = 1.0
            else:
                area = max(1e-12, (max(sa.x1, sb.x1) - min(sa.x0, sb.x0)) * (max(sa.y1, sb.y1) - min(sa.y0, sb.y0)))
                cell = max(sa.w, sb.w, math.sqrt(area / max(1, min(sa.n, sb.n))), 1e-9)
        self.cell = float(cell)
        levels = lambda df, c: sorted(r[0] for r in df.select(_level(F.col(c), self.cell).alias("l")).distinct().collect())  # noqa: E731  at most a few dozen
        self.left_levels, self.right_levels = levels(self.a, "_lb"), levels(self.b, "_rb")

    def cells(self, df: DataFrame, left: bool) -> DataFrame:
        """A row for each cell of each pair of levels (the grid is that of the coarser one)."""
        box, others = ("_lb", self.right_levels) if left else ("_rb", self.left_levels)
        df = df.withColumn("_own", _level(F.col(box), self.cell))
        df = df.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.greatest(F.col("_own"), F.lit(o)).alias("g")) for o in others])))
        size = F.lit(self.cell) * F.pow(F.lit(float(STEP)), F.col("_p.g"))
        along = lambda axis: F.sequence(F.floor(F.col(box)[f"min_{axis}"] / size), F.floor(F.col(box)[f"max_{axis}"] / size))
        df = df.withColumn("_cx", F.explode(along("x"))).withColumn("_cy", F.explode(along("y")))
        first, second = (F.col("_own"), F.col("_p.o")) if left else (F.col("_p.o"), F.col("_own"))
        return df.withColumn("_l1", first).withColumn("_l2", second).withColumn("_size", size).drop("_p", "_own")

    def cuts(self, parts: int) -> DataFrame | None:
        """Cells that hold over half a part of all pairs of rows (fewer than 2 * parts), with the numbers that their sides are cut in."""
        key = ["_l1", "_l2", "_cx", "_cy"]
        blocks = F.sum(F.ceil(F.col("_n") / BLOCK))
        count = lambda df, left, w, r: self.cells(df, left).groupBy(*key).agg(F.sum(F.col("_n").cast("double")).alias(w), blocks.cast("double").alias(r))
        met = count(self.a, True, "_wa", "_ra").join(count(self.b, False, "_wb", "_rb"), key).withColumn("_w", F.col("_wa") * F.col("_wb"))
        total = met.agg(F.sum("_w")).first()[0] or 0.0
        share = max(total / (2 * parts), LEAST_CUT)
        if total <= share:
            return None
        found = met.filter(F.col("_w") > share).withColumn("_s", F.ceil(F.col("_w") / share))
        own = F.least(F.col("_ra"), F.greatest(F.lit(1.0), F.ceil(F.sqrt(F.col("_s") * F.col("_ra") / F.col("_rb"))))).cast("int")
        rows = found.withColumn("_sa", own).withColumn("_sb", F.least("_rb", F.ceil(F.col("_s") / F.col("_sa"))).cast("int")).select(*key, "_sa", "_sb").filter("_sa * _sb > 1").collect()
        return self.a.sparkSession.createDataFrame(rows, "_l1 int, _l2 int, _cx bigint, _cy bigint, _sa int, _sb int") if rows else None

    def met(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs of a row of a and one of b (geometries with bounds, and other columns) that the predicate holds for."""
        if not self.left_levels or not self.right_levels:
            return a.join(b, F.lit(False))
        context = a.sparkSession.sparkContext
        parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism)
        key = ["_l1", "_l2", "_cx", "_cy", "_ca", "_cb"]
        la, rb = self.cells(a, True), self.cells(b, False).drop("_size")
        cuts = self.cuts(parts)
        if cuts is None:
            la, rb = (df.withColumn("_ca", F.lit(0)).withColumn("_cb", F.lit(0)) for df in (la, rb))
        else:
            deal = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns if c not in (*key, "_lb", "_rb", "_size")]), F.coalesce(n, F.lit(1))).cast("int")
            every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
            la = la.join(F.broadcast(cuts), key[:4], "left").withColumn("_ca", deal(la, F.col("_sa"))).withColumn("_cb", every(F.col("_sb"))).drop("_sa", "_sb")
            rb = rb.join(F.broadcast(cuts), key[:4], "left").withColumn("_cb", deal(rb, F.col("_sb"))).withColumn("_ca", every(F.col("_sa"))).drop("_sa", "_sb")
        # the number of partitions is fixed: what a task makes does not show in the bytes that it reads
        met = la.repartition(parts, *key).join(rb.repartition(parts, *key).hint("merge"), key)
        overlap = (F.col("_lb.min_x") <= F.col("_rb.max_x")) & (F.col("_lb.max_x") >= F.col("_rb.min_x")) & (F.col("_lb.min_y") <= F.col("_rb.max_y")) & (F.col("_lb.max_y") >= F.col("_rb.min_y"))
        once = (F.floor(F.greatest("_lb.min_x", "_rb.min_x") / F.col("_size")) == F.col("_cx")) & (F.floor(F.greatest("_lb.min_y", "_rb.min_y") / F.col("_size")) == F.col("_cy"))
        kept = met.filter(overlap & once)
        if isinstance(self.predicate, Column):
            kept = kept.filter(self.predicate)
        elif self.predicate == "dwithin":
            kept = kept.filter(F.call_function("st_dwithin", self.left_geom, self.right_geom, F.lit(float(self.distance))))
        elif self.predicate in BOUNDED:
            kept = kept.filter(F.call_function(f"st_{self.predicate}", self.left_geom, self.right_geom))
        return kept.drop(*key, "_size", "_lb", "_rb")

    def pairs(self) -> DataFrame:
        """The pairs of different geometries (of rows, if plain), with the numbers of their rows: _n on the left, _m on the right."""
        return self.met(self.a, self.b.withColumnRenamed("_n", "_m"))


def spatial_join(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, predicate: str | Column = "intersects", how: str = "inner", distance: float = 0.0, cell: float | None = None, measures: dict[str, Column] | None = None) -> DataFrame:
    """Joins where the predicate holds.

    predicate: a name of BOUNDED or "dwithin" (with distance) over GEOMETRY columns,
    "bounds" (bounds overlap), or a Column over both sides that implies that bounds (the
    left's grown by distance) overlap. how: inner, left, semi or anti. measures (inner):
    columns over the two geometries, computed once for each pair of different ones. Column
    names of the sides must differ. Null and empty geometries match nothing. Geometries
    are grouped, so that a coordinate -0.0 of a columnar type comes back as 0.0."""
    register(left.sparkSession)
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError(f"no join type {how!r}")
    if measures and how != "inner":
        raise ValueError("only an inner join has measures")
    names = left.columns
    if how != "inner":  # written, so that each step sees the same rows
        left = settle(left)
    sides = _Sides(left, right, left_geom, right_geom, predicate, distance, cell)
    if sides.plain:
        if how != "inner":  # numbered once and written, so that the rows that are joined back have the numbers that were joined
            left = settle(left.withColumn("_lid", F.monotonically_increasing_id()))
            sides = _Sides(left, right, left_geom, right_geom, predicate, distance, cell)
        joined = sides.pairs().drop("_n", "_m")
        row = "_lid"
    else:
        row = left_geom
        joined = None
    if how in ("semi", "anti"):
        return left.join(sides.pairs().select(row).distinct(), row, f"left_{how}").select(*names)
    if joined is None:
        a = _grown(_packed(left, left_geom, sides.a, "_ls"), left_geom, "_lb", distance)
        b = _grown(_packed(right, right_geom, sides.b, "_rs"), right_geom, "_rb")
        met = sides.met(a, b).select("*", *[c.alias(n) for n, c in (measures or {}).items()])
        met = met.withColumn("_l", F.explode("_ls")).drop("_ls").withColumn("_r", F.explode("_rs")).drop("_rs")
        of = lambda c, geom, row: F.col(c) if c == geom else F.col(row)[c].alias(c)
        joined = met.select(*[of(c, left_geom, "_l") for c in names], *[of(c, right_geom, "_r") for c in right.columns], *(measures or {}))
    elif measures:
        joined = joined.select("*", *[c.alias(n) for n, c in measures.items()])
    inner = joined.select(*names, *right.columns, *(measures or {}))
    if how == "inner":
        return inner
    rest = left.join(sides.pairs().select(row).distinct(), row, "left_anti")
    return inner.union(rest.select(*names, *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema]))


def match_counts(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, predicate: str | Column = "intersects", out: str = "n", distance: float = 0.0, cell: float | None = None) -> DataFrame:
    """The different geometries of the left that match any, with the number of right rows that each matches (as spatial_join has them)."""
    register(left.sparkSession)
    return _Sides(left, right, left_geom, right_geom, predicate, distance, cell).pairs().groupBy(left_geom).agg(F.sum("_m").alias(out))


def _usable(df: DataFrame, point: str) -> DataFrame:
    """Rows whose point is neither null nor empty nor infinite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.filter(finite(F.col(point)["x"]) & finite(F.col(point)["y"]))


def knn_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_point: str, right_point: str, k: int, cell: float) -> DataFrame:
    """For each left point the k nearest right points (POINT_2D; ties to the smaller right id), as left_id, right_id, distance, rank.

    Different points are searched for, among the k rows of each different place that can be
    found (those of the smallest ids). Rings of cells are searched, doubling the reach until k
    are found within it, so each round is an equi-join on cells of the points that are still
    open; what is found and what is open are written each round. The first reach is cell, or
    less where points lie so densely that k are nearer. The reach ends with the extent of all
    points, where a search meets every right point. Rows whose point is null, empty or infinite
    find nothing and are not found; if there are fewer than k right points, all are found;
    rows that repeat an id are points of their own; a side without points gives no rows."""
    register(left.sparkSession)
    distance = F.call_function("st_distance_point2d", left_point, right_point).alias("distance")
    rows = _usable(left.select(left_id, left_point), left_point)
    open_ = settle(rows.select(left_point).distinct())
    first = Window.partitionBy(right_point).orderBy(right_id)
    points = settle(_usable(right.select(right_id, right_point), right_point).withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= k).drop("_k"))
    extent = lambda df, p: df.agg(F.count("*").alias("n"), *[f(F.col(p)[o]).alias(f"{o}{e}") for o in "xy" for e, f in (("a", F.min), ("b", F.max))]).first()
    a, b = extent(open_, left_point), extent(points, right_point)
    total = b.n
    if not a.n or not total:
        return rows.join(points, F.lit(False)).select(left_id, right_id, distance, F.lit(1).alias("rank"))
    span = max(max(a.xb, b.xb) - min(a.xa, b.xa), max(a.yb, b.yb) - min(a.ya, b.ya))
    best = Window.partitionBy(left_point).orderBy("distance", right_id)
    done, size = None, float(cell)
    if (area := (b.xb - b.xa) * (b.yb - b.ya)) > 0:
        size = min(size, math.sqrt(area * k / total))
    while True:
        r = points.withColumn("_cx", F.floor(F.col(right_point)["x"] / size)).withColumn("_cy", F.floor(F.col(right_point)["y"] / size))
        near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        l = open_.withColumn("_n", F.explode(near)).withColumn("_cx", F.floor(F.col(left_point)["x"] / size) + F.col("_n.i")).withColumn("_cy", F.floor(F.col(left_point)["y"] / size) + F.col("_n.j")).drop("_n")  # noqa: E741
        met = settle(l.join(r, ["_cx", "_cy"]).select(left_point, right_id, distance).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
        last = size > span  # all points have been met
        sure = met if last else met.filter(F.col("distance") <= size)  # all points within the reach have been met
        full = sure.groupBy(left_point).count().filter(F.col("count") >= min(k, total)).select(left_point)
        got = met.join(full, left_point, "left_semi")
        done = got if done is None else done.union(got)
        if not last:
            old, open_ = open_, settle(open_.join(full, left_point, "left_anti"))
            drop(old)
        if last or open_.isEmpty():
            return rows.join(done, left_point).select(left_id, right_id, "distance", "rank")
        size *= 2
