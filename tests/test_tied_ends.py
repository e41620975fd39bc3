"""Rows 1000 to 1009 of the grid of suppliers share patterns with columns, so two groups may be first; which of them counts must not depend on the order of the table's rows."""

import harness as H
import pytest

from stopgrid.catalog import QUERIES, SQL


@pytest.mark.parametrize("order", ["k", "k between 10000 and 10099 desc, k", "k desc"])
def test_ends_in_any_order(spark, tmp_path, monkeypatch, order):
    """The SQL leaves the order of such groups open, so a copy that fixes it is compared."""
    d = tmp_path / "ends"
    d.mkdir()
    H.connect("sf0.001").execute(f"copy (select k s_suppkey, k::varchar s_name, 1::int s_nationkey, 1.0::double s_acctbal from range(15000) r(k) order by {order}) to '{d}/supplier.parquet'")
    monkeypatch.setattr(H, "DATA", str(tmp_path))
    sql = SQL["edge_set_overlap"].replace("order by pos)", "order by pos, g)").replace("(g, pos)", "(g, row(pos, g))")
    assert sql.count("pos, g)") == 5
    assert H.differ(spark, H.connect("ends"), QUERIES["edge_set_overlap"], sql, "ends") is None
