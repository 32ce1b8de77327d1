"""Plans that would not survive scale fail here."""

import os

import pytest

from tempofold.catalogue import ORACLES, QUERIES
from tempofold.plans import check

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


@pytest.mark.parametrize("name", ["near_dup_pairs", "shift_match", "asof_sample", "nearest_within", "band_join_counts", "grid_score", "daily_cap", "sliding_limit",
                                  "peaks", "auc", "rule_sweep", "zero_shot", "orphan_audit", "report_daily", "plane_fit", "moving_avg", "track_links"])
def test_no_nested_loops(spark, name):
    assert check.problems(QUERIES[name](spark, DATA)) == []


def test_scans_read_only_their_columns(spark):
    assert check.columns_read(QUERIES["exact_dups"](spark, DATA)) == {"doc_id", "text"}
    assert check.columns_read(QUERIES["topk_recent"](spark, DATA)) <= {"o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"}


def test_filters_reach_the_scan(spark):
    assert "event_type" in check.pushed_filters(QUERIES["lockout"](spark, DATA))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_text_rules_do_not_shuffle(spark):
    for name in ("scrub", "tidy", "url_keys", "error_classes", "validate_events"):
        assert check.exchanges(QUERIES[name](spark, DATA)) == 0
