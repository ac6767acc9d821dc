"""Every registered query against its check SQL, and the plans that matter at scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_point  # noqa: E402
from millrace import plans  # noqa: E402
from tools import check_queries  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return check_queries.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_check(spark, con, sf_dir, name):
    assert name in plans.CHECKS, "every query has a check"
    df = plans.QUERIES[name](spark, sf_dir)
    n, problems = check_queries.compare(df, con, plans.CHECKS[name])
    assert not problems, problems
    assert n > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    # one-row sides only: the reference time of a range
    assert "BroadcastNestedLoopJoin" not in plan or name == "series_recent"


def test_entry_point(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert entry_point.entry(spark).count() == 5


def plan_of(spark, sf_dir, name):
    return plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_filters_pushed(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "station_stats")
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_totalprice)" in plan_of(
        spark, sf_dir, "row_filters"
    )


def test_aggregates_combine_before_the_shuffle(spark, sf_dir):
    for name in ("station_stats", "delay_by_supplier", "word_count", "downsample"):
        plan = plan_of(spark, sf_dir, name)
        assert "partial_" in plan, name
        assert plan.index("partial_") > plan.index("Exchange"), name


def test_sequences_need_one_exchange(spark, sf_dir):
    for name in ("row_index", "dedupe_consecutive", "cache_hit_miss", "replace_append", "asof_param"):
        assert plan_of(spark, sf_dir, name).count("Exchange hashpartitioning") == 1, name
