"""Physical plans: what must and must not be in them at any size of the tables."""

import re

import pytest

import __spark_entry__ as entry
from wanderlens.operators import residents, social, visitors
from wanderlens.sources.derived import DerivedInputs
from wanderlens.sources.stored import stored

FOLDER = "/root/testdata/sf0.001"
PYTHON = {"best_route", "representative_route"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_join_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("ArrowEvalPython" in plan) == (name in PYTHON)


@pytest.mark.parametrize("name", ["visitor_detect", "spot_flow_prov_month", "visitor_flow_by_prov", "top3_locations"])
def test_month_and_columns_reach_the_scan(spark, name):
    execution = entry.queries()[name](spark, FOLDER)._jdf.queryExecution()
    plan = spark._jvm.PythonSQLUtils.explainString(execution, "formatted")
    pushed = re.findall(r"PushedFilters: \[([^\]]*)", plan)
    # The derived tables repeat events 31 days earlier or later, so the range at the files is that much wider.
    assert any("GreaterThanOrEqual(ts,2023-12-01" in p and "LessThan(ts,2024-03-03" in p for p in pushed)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", plan)
    assert schemas and ("event_type" in plan) == (name in {"spot_flow_prov_month", "top3_locations"})


# --- joins without broadcasts, over plain tables ---


@pytest.fixture(scope="module")
def plain_tables(spark, tmp_path_factory):
    """The inputs of sf 0.001 as files of their own, so that every read of one shows in a plan."""
    folder = tmp_path_factory.mktemp("plain")
    inputs = DerivedInputs(spark, FOLDER)
    names = ["visitor_record", "local_record", "visitor_stop", "local_stop", "cdr", "base_station", "scenic_spot", "poi", "user_home", "user_work"]
    for name in names:
        getattr(inputs, name).write.parquet(str(folder / name))
    return {name: spark.read.parquet(str(folder / name)) for name in names}


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def reads(plan, table):
    return len(re.findall(rf"FileScan parquet [^\n]*/{table}\]", plan))


def test_profiles_read_each_fact_table_once(plain_tables, no_broadcast):
    t = plain_tables
    visitor = visitors.detect_visitors(t["visitor_record"], "202401")
    profile = plan_of(visitors.visitor_profile(
        stored(visitor, "visitor"), t["visitor_stop"], t["local_record"], t["cdr"], t["scenic_spot"], t["poi"],
        t["base_station"], "202401"))
    assert "SortMergeJoin" in profile
    assert {n: reads(profile, n) for n in ("visitor_stop", "cdr", "local_record")} == {"visitor_stop": 1, "cdr": 1, "local_record": 1}
    profile = plan_of(residents.resident_profile(
        t["cdr"], t["scenic_spot"], t["local_record"], t["local_stop"], t["user_home"], t["user_work"]))
    assert {n: reads(profile, n) for n in ("local_stop", "cdr", "local_record")} == {"local_stop": 1, "cdr": 1, "local_record": 1}


def test_calls_are_shuffled_once_for_all_features(spark, plain_tables, no_broadcast):
    t = plain_tables
    users = residents.resident_users(t["local_record"])
    plan = plan_of(social.call_features(users, t["cdr"]))
    assert reads(plan, "cdr") == 1
    state = plan_of(social.call_state(t["cdr"]))
    assert reads(state, "cdr") == 1 and state.count("Exchange hashpartitioning") == 1
    features = plan_of(social.social_features(users, t["cdr"], t["user_home"], t["user_work"]))
    assert reads(features, "cdr") == 0  # all of it comes from the stored pairs


@pytest.mark.parametrize("name", ["visitor_profile", "resident_profile", "call_features", "commute_time", "poi_tfidf"])
def test_no_cross_join_without_broadcasts(spark, no_broadcast, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
