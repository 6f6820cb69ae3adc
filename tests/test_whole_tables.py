"""The catalog's joins over whole tables, against brute force."""

import pytest

from tessera import catalog

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def rows(spark):
    def read(name, *columns):
        return [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/{name}.parquet").select(*columns).collect()]

    boxes = {k: (k * 7 % 100, k * 11 % 100, k * 7 % 100 + 1 + s % 10, k * 11 % 100 + 1 + s % 10) for k, s in read("part", "p_partkey", "p_size")}
    orders = {k: (k * 37 % 360 - 180, k * 53 % 170 - 85, c) for k, c in read("orders", "o_orderkey", "o_custkey")}
    customers = {k: (k * 29 % 360 - 180, k * 31 % 170 - 85) for (k,) in read("customer", "c_custkey")}
    return boxes, orders, customers


def meet(a, b):
    return a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]


@pytest.mark.parametrize("name", ["predicates", "overlay_areas"])
def test_box_pairs(spark, rows, name):
    boxes = rows[0]
    got = {(r.p_partkey, r.q): r for r in catalog.QUERIES[name](spark, SF_SMALL).collect()}
    assert set(got) == {(p, q) for p in boxes for q in boxes if meet(boxes[p], boxes[q])}
    for (p, q), r in got.items():
        a, b = boxes[p], boxes[q]
        shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        assert r.apart == sum(not meet(a, x) for x in boxes.values())
        if name == "predicates":
            assert r.i and not r.d and r.e == (a == b) and r.t == (shared == 0)
        else:
            assert r.i == shared and r.d == (a[2] - a[0]) * (a[3] - a[1]) - shared


@pytest.mark.parametrize("name", ["box_self_join", "spatial_left_join", "spatial_semi_join", "spatial_anti_join"])
def test_box_joins(spark, rows, name):
    boxes, orders, _ = rows
    got = sorted(map(tuple, catalog.QUERIES[name](spark, SF_SMALL).collect()), key=str)
    if name == "box_self_join":
        want = [(p, q) for p in boxes for q in boxes if meet(boxes[p], boxes[q])]
    else:
        hits = {o: [p for p, b in boxes.items() if b[0] <= x <= b[2] and b[1] <= y <= b[3]] for o, (x, y, _) in orders.items()}
        want = {"spatial_left_join": [(o, p) for o, h in hits.items() for p in h or [None]], "spatial_semi_join": [(o,) for o, h in hits.items() if h], "spatial_anti_join": [(o,) for o, h in hits.items() if not h]}[name]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("name", ["dwithin_join", "knn_join", "union_agg_area"])
def test_points(spark, rows, name):
    _, orders, customers = rows
    got = sorted(map(tuple, catalog.QUERIES[name](spark, SF_SMALL).collect()))
    if name == "union_agg_area":
        want = [(g, float(len({(x, y) for x, y, c in orders.values() if c % 7 == g}))) for g in {c % 7 for _, _, c in orders.values()}]
    else:
        near = {c: sorted(((x - a) ** 2 + (y - b) ** 2, o) for o, (x, y, _) in orders.items()) for c, (a, b) in customers.items()}
        want = [(o, c) for c, n in near.items() for d, o in n if d <= 9] if name == "dwithin_join" else [(c, o, r) for c, n in near.items() for r, (_, o) in enumerate(n[:3], 1)]
    assert got == sorted(want)
