"""What the planner makes of the queries."""

import re

import pytest

import __spark_entry__ as contract
from assaylake.operators import logins, recommend
from assaylake.plans import roles
from test_contract import MODELS

STREAMS = {name for name in contract.queries() if name.startswith("stream_")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffling(spark):
    """No broadcast by size, as for tables that are too large for it."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - MODELS - STREAMS))
def test_no_pairs_and_no_python(spark, data, shuffling, name):
    plan = plan_of(contract.queries()[name](spark, data))
    for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in plan


def test_small_users_are_broadcast(spark, data):
    decided = logins.decide_logins(roles.attempts(spark, data), roles.users(spark, data))
    assert "BroadcastHashJoin [collationkey" in plan_of(decided)


def test_large_users_are_hashed_not_sorted(spark, data, shuffling):
    decided = logins.decide_logins(roles.attempts(spark, data), roles.users(spark, data))
    decided.collect()
    final = plan_of(decided).split("+- == Initial Plan ==")[0]
    assert "ShuffledHashJoin [collationkey" in final
    assert "SortMergeJoin [collationkey" not in final


def test_only_needed_columns_are_read(spark, data):
    plan = contract.queries()["dashboard_stats"](spark, data)._jdf.queryExecution().toString()
    read = set(re.findall(r"ReadSchema: (struct<[^\n]*>)", plan))
    assert read == {
        "struct<l_orderkey:bigint,l_returnflag:string>",
        "struct<o_orderkey:bigint,o_custkey:bigint>",
        "struct<c_custkey:bigint>",
    }


def test_filters_reach_the_scan(spark, data):
    plan = contract.queries()["delete_status"](spark, data)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c_custkey)]" in plan


@pytest.mark.parametrize(
    "name, partial",
    [
        ("last_login", "partial_max_by"),
        ("login_usage_hourly", "partial_count"),
        ("register_reject", "partial_min_by"),
        ("user_patch", "partial_max_by"),
        ("lit_dedup", "partial_min"),
        ("effectiveness", "partial_sum"),
        ("dashboard_stats", "partial_sum"),
    ],
)
def test_groups_are_reduced_before_they_move(spark, data, name, partial):
    assert partial in plan_of(contract.queries()[name](spark, data))


def test_ranking_sends_k_rows(spark, data):
    plan = plan_of(contract.queries()["recommend_topk"](spark, data))
    assert re.search(r"WindowGroupLimit .*row_number\(\), 5, Partial", plan)
    scored = spark.createDataFrame(
        [(1, 0.5, 0.1, 2, 3)],
        "query_id long, score double, confidence double, temperature_bin long, pressure_bin long",
    )
    assert "TakeOrderedAndProject" in plan_of(recommend.best_of_one(scored, 1, 3))
    assert "TakeOrderedAndProject" in plan_of(contract.queries()["lit_search"](spark, data))


def test_range_join_is_an_equi_join(spark, data, shuffling):
    plan = plan_of(contract.queries()["constraint_match"](spark, data))
    assert re.search(r"Join \[experiment_type#\d+, coalesce\(_bucket#\d+L, 0\), isnull\(_bucket#\d+L\)\]", plan)
