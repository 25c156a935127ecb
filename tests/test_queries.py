"""Registered queries against their SQL, and the shape of their plans."""

import os

import pytest

import __spark_entry__ as entry
import compare

SQL = entry.oracle_sql()
QUICK = [
    "hourly_series", "null_report", "missing_hours_by_user", "densify", "feature_table", "feature_table_by_user",
    "load_heatmap", "iqr_bounds", "row_index", "chrono_split", "sequences", "overlapping_windows", "seasonal_naive_24",
    "forecast_metrics", "detect_flags", "full_analysis", "score_windows", "csv_roundtrip",
    "null_cells_error", "null_load_pairs", "unknown_series_flags", "feature_table_chunks", "row_index_blocks", "sequences_chunks",
]
NAMES = sorted(SQL) if os.environ.get("TIDEWATT_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def connection(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, folder, connection, name):
    got = entry.queries()[name](spark, folder).toPandas()
    assert len(got) and compare.difference(got, connection.sql(SQL[name]).df()) is None


def test_sums_of_168_rows_equal_their_sql(spark, folder, connection):
    # some sums are half a whole number: the order in which the doubles are added decides
    names = ["series_id", "split", "origin_ts", "column", "total"]
    got = entry.queries()["sequences_all_columns"](spark, folder).toPandas()[names]
    assert compare.difference(got, connection.sql(SQL["sequences_all_columns"]).df()[names]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert {"series_id", "timestamp", "load", "rolling_mean_168"} <= set(df.columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["feature_table_by_user", "row_index", "chrono_split", "overlapping_windows", "last_168"])
def test_no_window_over_everything(spark, folder, name):
    text = plan(entry.queries()[name](spark, folder))
    windows = [line for line in text.splitlines() if "Window [" in line or "Window(" in line]
    assert windows and "SinglePartition" not in text.split("Window", 1)[1].split("\n")[1]
    for line in windows:
        assert "], [series_id" in line


def test_feature_plan(spark, folder):
    text = plan(entry.queries()["feature_table_by_user"](spark, folder))
    # one sort and one shuffle by (series, chunk) serve lags and rolling values
    assert text.count("_chunk") and text.count("Sort [series_id") == 1
    assert "BroadcastHashJoin" in text  # the holiday table


def test_scan_reads_only_what_it_needs(spark, folder):
    from tidewatt.plans import driver_loads

    text = plan(driver_loads.hourly_events(spark, folder))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text


@pytest.mark.parametrize("name", ["last_168", "seasonal_naive_24", "extended_naive_168", "features_from"])
def test_only_the_tail_is_read(spark, folder, name):
    text = plan(entry.queries()[name](spark, folder))
    assert "GreaterThanOrEqual(ts," in text


def test_last_rows_are_limited_before_the_shuffle(spark, folder):
    text = plan(entry.queries()["last_168"](spark, folder))
    assert text.count("WindowGroupLimit") == 2
