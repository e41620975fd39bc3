"""The line table of suppliers whose keys are held by two rows, as in copies shifted too little, or whose nations are unknown."""

import harness as H

from stopgrid.catalog import QUERIES, SQL


def test_length_of_lines(spark, tmp_path, monkeypatch):
    """A stop of row 5 and of column 9 is one group given twice."""
    d = tmp_path / "twice"
    d.mkdir()
    H.connect("sf0.001").execute(f"copy (select k s_suppkey, k::varchar s_name, (k % 25)::int s_nationkey, 1.0::double s_acctbal from (select unnest(range(70) || [59]) k)) to '{d}/supplier.parquet'")
    monkeypatch.setattr(H, "DATA", str(tmp_path))
    assert H.differ(spark, H.connect("twice"), QUERIES["agg_line"], SQL["agg_line"], "twice") is None


def test_unknown_regions(spark, tmp_path, monkeypatch):
    """Suppliers without a nation: none of the regions of a line, and last where two are as frequent."""
    d = tmp_path / "unknown"
    d.mkdir()
    H.connect("sf0.001").execute(f"copy (select k s_suppkey, k::varchar s_name, case when k % 2 = 0 then k // 20 end::int s_nationkey, 1.0::double s_acctbal from range(70) r(k)) to '{d}/supplier.parquet'")
    monkeypatch.setattr(H, "DATA", str(tmp_path))
    assert H.differ(spark, H.connect("unknown"), QUERIES["agg_line"], SQL["agg_line"], "unknown") is None
