"""As in test_tied_ends: where two groups hold one position of a pattern, the lesser comes first, whatever the order of the table's rows."""

import harness as H
import pytest

from stopgrid.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def grids(tmp_path_factory):
    """A grid with ties in row 1000, its rows in two orders."""
    d = tmp_path_factory.mktemp("order")
    for name, order in (("up", "k"), ("rows_first", "k >= 10000 desc, k desc")):
        (d / name).mkdir()
        H.connect("sf0.001").execute(f"copy (select k s_suppkey, k::varchar s_name, (k % 25)::int s_nationkey, 1.0::double s_acctbal from (select unnest(range(70) || range(10000, 10030)) k) order by {order}) to '{d}/{name}/supplier.parquet'")
    return d


@pytest.mark.parametrize("name", ["agg_line", "cell_index_range_query", "estimate_minutes", "win_running_min_board"])
def test_lesser_group_first(spark, grids, monkeypatch, name):
    """The SQL leaves the order of such groups open, so a copy that fixes it is compared."""
    monkeypatch.setattr(H, "DATA", str(grids))
    sql = SQL[name].replace("select pat, pos, cum, (g * 7", "select pat, pos, g, cum, (g * 7")
    for a, b in (("order by pos)", "order by pos, g)"), ("order by pos rows", "order by pos, g rows"), ("order by h.pos rows", "order by h.pos, h.g rows")):
        sql = sql.replace(a, b)
    assert sql != SQL[name]
    for order in ("up", "rows_first"):
        assert H.differ(spark, H.connect(order), QUERIES[name], sql, order) is None
