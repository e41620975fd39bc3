"""As in test_tied_positions: the hops where two groups hold one position are the same in any order of the table's rows and in any number of parts."""

import harness as H
import pytest

from stopgrid.catalog import QUERIES, SQL

ORDERS = {"up": "k", "down": "k desc", "rows_first": "k >= 10000 desc, k", "mixed": "k * 37 % 101"}


@pytest.mark.parametrize("name", ["agg_edge_frequency", "haversine_m"])
def test_any_order_of_rows(spark, tmp_path, monkeypatch, name):
    """The SQL leaves the order of such groups open, so a copy that fixes it is compared."""
    monkeypatch.setattr(H, "DATA", str(tmp_path))
    sql = SQL[name].replace("order by pos)", "order by pos, g)")
    assert sql != SQL[name]
    for d, order in ORDERS.items():
        (tmp_path / d).mkdir()
        H.connect("sf0.001").execute(f"copy (select k s_suppkey, k::varchar s_name, (k % 25)::int s_nationkey, 1.0::double s_acctbal from (select unnest(range(70) || range(10000, 10100)) k) order by {order}) to '{tmp_path}/{d}/supplier.parquet'")
    for d in ORDERS:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            try:
                assert H.differ(spark, H.connect(d), QUERIES[name], sql, d) is None
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", "4")
