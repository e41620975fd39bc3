"""Rows 1000 to 1002 of the grid of suppliers share patterns with columns, so two groups may have one position; the lesser group comes first."""

import harness as H
import pytest

from stopgrid.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def grid(tmp_path_factory):
    """Seventy suppliers and three rows far north of them, the last one first."""
    d = tmp_path_factory.mktemp("ties")
    H.connect("sf0.01").execute(f"copy (select * replace (case when s_suppkey < 70 then s_suppkey else 9930 + s_suppkey end as s_suppkey) from supplier where s_suppkey < 100 order by s_suppkey desc) to '{d}/supplier.parquet'")
    return d


@pytest.mark.parametrize("name", ["agg_edge_frequency", "haversine_m"])
def test_lesser_group_first(spark, grid, monkeypatch, name):
    """The SQL leaves the order of such groups open, so a copy that fixes it is compared."""
    monkeypatch.setattr(H, "DATA", str(grid.parent))
    con = H.connect(grid.name)
    sql = SQL[name].replace("order by pos)", "order by pos, g)")
    assert sql != SQL[name]
    assert H.differ(spark, con, QUERIES[name], sql, grid.name) is None
