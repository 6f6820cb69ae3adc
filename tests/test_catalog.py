"""Every registered query runs, with the columns that its SQL names; new fixtures against brute force."""

import math
import re

import pytest

from tessera import catalog

from .conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF_SMALL)
    rows = got.collect()
    assert rows and len(got.columns) == len(set(got.columns))
    if name in catalog.ORACLE_SQL:
        assert all(re.search(rf"\b{c}\b", catalog.ORACLE_SQL[name]) for c in got.columns)


@pytest.fixture(scope="module")
def orders(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_custkey").collect()]


def test_line_predicates(spark, orders):
    got = {r.k: r for r in catalog.QUERIES["line_predicates"](spark, SF_SMALL).collect()}
    seen = set()
    for k, c in orders:
        v, a = k % 13 - 1, c % 7
        b = a + 1 + k % 5
        meets, inside = 0 <= v <= 10 and a <= 5 <= b, 0 < v < 10 and a < 5 < b
        far = math.hypot(max(0, -v, v - 10), max(0, a - 5, 5 - b))
        r = got[k]
        assert (r.c, r.i, r.d, r.t, r.w) == (inside, meets, not meets, meets and not inside, far <= 1)
        assert r.far == pytest.approx(far) and r.s == pytest.approx(far)
        seen.add((inside, meets))
    assert len(got) == len(orders) and len(seen) == 3


def test_ring_validity(spark, orders):
    got = {r.k: r for r in catalog.QUERIES["ring_validity"](spark, SF_SMALL).collect()}
    for k, c in orders:
        simple = 2 * (k % 5) + 1 > 2 * (c % 6)
        assert (got[k].s, got[k].r, got[k].v, got[k].cv, got[k].c, got[k].pr, got[k].fixed) == (simple, simple, simple, simple, k % 2 == 1, simple and k % 2 == 1, True)
    assert {r.v for r in got.values()} == {True, False}


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.startswith("source_") and n not in ("source_meta", "source_window")])
def test_sources_give_back_what_was_written(spark, name):
    want = sorted((r.p_partkey, r.p_name, round(r.p_retailprice, 2), float(r.p_partkey * 7 % 100), float(r.p_partkey * 11 % 100 + 1 + r.p_size % 10)) for r in spark.read.parquet(f"{SF_SMALL}/part.parquet").collect())
    assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, SF_SMALL).select("id", "name", "price", "x", "y").collect()) == want
