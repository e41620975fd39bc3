"""Minutes along lines of many stops, to the last place that is rounded to."""

import harness as H

from stopgrid.catalog import QUERIES, SQL


def test_last_place(spark, tmp_path, monkeypatch):
    """One column of 990 suppliers far apart, no position twice; ``differ`` would pass over one ten-thousandth in millions."""
    d = tmp_path / "far"
    d.mkdir()
    H.connect("sf0.001").execute(f"copy (select i * 50020 s_suppkey, i::varchar s_name, 1::int s_nationkey, 1.0::double s_acctbal from range(990) r(i)) to '{d}/supplier.parquet'")
    monkeypatch.setattr(H, "DATA", str(tmp_path))
    got = {(r.pat, r.pos): r.minutes for r in QUERIES["estimate_minutes"](spark, str(d)).collect()}
    want = {(pat, pos): m for pat, pos, m in H.connect("far").execute(SQL["estimate_minutes"]).fetchall()}
    assert len(want) == 1980
    assert {k: (m, want.get(k)) for k, m in got.items() if m != want.get(k)} == {}
