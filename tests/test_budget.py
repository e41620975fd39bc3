"""Budgets over more items than the driver takes at once."""

import random

import harness as H
import pytest

from stopgrid.catalog import QUERIES, SQL
from stopgrid.operators import ranks as R


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Orders of sf0.01 repeated with shifted keys to 2.1 million."""
    d = tmp_path_factory.mktemp("sf")
    con = H.connect("sf0.01")
    con.execute(f"copy (select o.* replace (o_orderkey + i * 15000 as o_orderkey, o_custkey + i * 1500 as o_custkey) from orders o, range(140) r(i)) to '{d}/orders.parquet'")
    return d


@pytest.mark.parametrize("first,ranges", [(7, 40), (500, 100), (20_000, 250_000)])
def test_greedy_in_ranges(spark, monkeypatch, first, ranges):
    """The items of all ranges are gone through, as one by one."""
    monkeypatch.setattr(R, "GREEDY_FIRST", first)
    monkeypatch.setattr(R, "GREEDY_ROWS", ranges)
    r = random.Random(5)
    items = [(r.randrange(60), i, float(r.randrange(-2, 40)), float(r.randrange(0, 30))) for i in range(500)]
    want = set()
    for b in (3.0, 40.0, 5000.0):
        used, spent = set(), 0.0
        ok = [x for x in items if x[2] > 0 and x[3] > 0]
        for line, item, _, cost in sorted(ok, key=lambda x: (-round(x[2] / x[3], 9), x[0], x[1])):
            if line not in used and spent + cost <= b:
                used.add(line)
                spent += cost
                want.add((b, item, spent))
    got = R.greedy_budget(spark.createDataFrame(items, "line bigint, item bigint, benefit double, cost double"), (3, 40, 5000))
    assert sorted((x.budget, x.item, x.spent) for x in got.collect()) == sorted(want)


@pytest.mark.parametrize("name", ["greedy_budget", "agg_capture", "agg_portfolio", "portfolio_item_index", "topk_portfolio_items"])
def test_many_items(spark, many, name):
    got = QUERIES[name](spark, str(many))
    assert got.count() > 0
