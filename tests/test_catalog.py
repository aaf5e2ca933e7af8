"""Every registered query against its SQL on the smallest driver tables, and rules on the plans."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())
SQL = entry.oracle_sql()
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@needs_tables
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    result, _ = compare(spark, duck, SF, name, entry.queries()[name], SQL.get(name))
    assert not result.startswith("FAIL"), result
    assert "TYPES" not in result, result


@needs_tables
def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


PLANS = [
    "flt10_trim_by_group_quantile", "f9_dictionary_encode", "f11_zscore", "k1_map_by_name", "k3_map_cascade", "k4_fuzzy_match", "j1_asof_next", "j3_match_event_window",
    "j4_next_n_arrivals", "j11_nearest_hour_weather", "g5_snap_to_shape", "g6_project_onto_polyline", "w2_gps_speed", "w4_rolling_stats", "w6_history_window",
    "e2_idle_streaks", "e4_dwell_events", "e8_label_by_lookback", "v2_sliced_metrics", "v5_error_percentiles", "q6_weather_coverage", "q10_telemetry_issues",
]


@needs_tables
@pytest.mark.parametrize("name", PLANS)
def test_plan_stays_on_the_jvm_and_forms_no_products(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "InPandas"):
        assert word not in plan, f"{name}: {word}"


@needs_tables
def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["flt2_filter_speed"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(value,65", plan)
    assert "props" not in plan and "event_type" not in plan


@needs_tables
def test_hot_key_work_is_partitioned_by_slice(spark):
    """As-of, lag and rolling plans exchange on (key, slice), never on the vehicle alone."""
    for name in ("j1_asof_next", "w3_rolling_time", "w2_gps_speed", "w6_history_window"):
        plan = plan_of(entry.queries()[name](spark, SF))
        exchanges = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
        assert exchanges and all("_slice" in e for e in exchanges), (name, exchanges)
