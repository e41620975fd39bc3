"""Registered queries against their SQL."""

import os

import harness as H
import pytest

from stopgrid.catalog import QUERIES, SQL
from stopgrid.flagship import PATTERN_GRADES_SQL, pattern_grades

pytestmark = pytest.mark.skipif(not os.path.isdir(H.DATA), reason="no test tables")
#: Those that take SQL or models longest are left to the driver's own comparison.
SLOW = {"agg_capture", "agg_portfolio", "topk_portfolio_items", "portfolio_item_index", "policy_extension", "link_summary", "removed_pairs", "line_removal_people", "line_segment_dependency", "affected_pairs_filter", "segment_dedupe_by_grade", "stat_sensitivity_summary", "sssp_limit", "sssp_no_walk", "sssp_closed", "sssp_wait_scale", "sssp_extra_links", "sssp_multi_origin"}
QUICK = sorted(set(SQL) - SLOW)


@pytest.fixture(scope="module")
def con():
    return H.connect("sf0.01")


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, con, name):
    assert H.differ(spark, con, QUERIES[name], SQL[name], "sf0.01") is None


def test_flagship(spark, con):
    assert H.differ(spark, con, pattern_grades, PATTERN_GRADES_SQL, "sf0.01") is None


def test_names_match():
    assert set(SQL) <= set(QUERIES)
