"""The grid of suppliers with rows numbered like the columns that have no line."""

import shutil

import harness as H
import pytest

from stopgrid.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def grid(tmp_path_factory):
    """Seventy suppliers, and three rows, 1002 to 1004, far north of them."""
    d = tmp_path_factory.mktemp("grid")
    con = H.connect("sf0.01")
    for t in ("nation", "region", "customer", "orders", "lineitem"):
        shutil.copy(f"{H.DATA}/sf0.001/{t}.parquet", d)
    con.execute(f"copy (select s.* replace (k as s_suppkey) from (select *, case when s_suppkey < 70 then s_suppkey else 10020 + s_suppkey - 70 end k from supplier where s_suppkey < 100) s) to '{d}/supplier.parquet'")
    return d


NAMES = "cc_lines data_status edge_set_overlap estimate_minutes group_trips agg_edge_frequency agg_group_service agg_line agg_stop_trips_by_line built_lines win_running_min_board haversine_m is_station".split()


@pytest.mark.parametrize("name", NAMES)
def test_lines_of_the_rows(spark, grid, monkeypatch, name):
    monkeypatch.setattr(H, "DATA", str(grid.parent))
    assert H.differ(spark, H.connect(grid.name), QUERIES[name], SQL[name], grid.name) is None
