"""As in test_tied_hops, but with the SQL as it stands: the rows that it fixes, as no group in them shares a position, are the queries' rows."""

import harness as H
import pytest

from stopgrid import views as V
from stopgrid.catalog import QUERIES, SQL

ORDERS = {"up": "k", "rows_first": "k >= 10000 desc, k desc"}
TIED = V.with_views("select pat * 100000 + pos, g from f2_ps where (pat, pos) in (select (pat, pos) from f2_ps group by pat, pos having count(*) > 1)", "f2_ps")
#: Rows that the SQL fixes, by the tied groups {g} and places {p}; both engines read this.
FIXED = {
    "agg_edge_frequency": "a not in {g} and b not in {g}",
    "haversine_m": "pat * 100000 + pos not in {p} and pat * 100000 + pos + 1 not in {p}",
    "win_running_min_board": "pat * 100000 + pos not in {p}",
    "cell_index_range_query": "cast(split_part(id, '-', 1) as bigint) not in {g} and cast(split_part(id, '-', 2) as bigint) not in {g}",
}


@pytest.mark.parametrize("name", FIXED)
def test_rows_that_the_sql_fixes(spark, tmp_path, monkeypatch, name):
    """Row 1000 shares positions with column 0 only."""
    monkeypatch.setattr(H, "DATA", str(tmp_path))
    for d, order in ORDERS.items():
        (tmp_path / d).mkdir()
        H.connect("sf0.001").execute(f"copy (select k s_suppkey, k::varchar s_name, (k % 25)::int s_nationkey, 1.0::double s_acctbal from (select unnest(range(70) || range(10000, 10010)) k) order by {order}) to '{tmp_path}/{d}/supplier.parquet'")
        con = H.connect(d)
        p, g = (f"({', '.join(map(str, sorted(set(c))))})" for c in zip(*con.execute(TIED).fetchall()))
        fixed = FIXED[name].format(p=p, g=g)
        every, left = (con.execute(f"select count(*) from ({SQL[name]}) where {w}").fetchone()[0] for w in ("true", fixed))
        assert 0 < left < every
        assert H.differ(spark, con, lambda s, at: QUERIES[name](s, at).where(fixed), f"select * from ({SQL[name]}) where {fixed}", d) is None
