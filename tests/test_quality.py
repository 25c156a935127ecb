import pytest

from frames import series
from tidewatt.errors import InputError
from tidewatt.operators import quality
from tidewatt.schema import FEATURE_COLUMNS


@pytest.fixture
def untidy(spark):
    return spark.createDataFrame(
        [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 01:00:00", 2.0), ("a", "2024-01-01 01:00:00", 3.0),
         ("a", "2024-01-01 03:00:00", None), ("a", "soon", 4.0), ("a", "later", float("nan"))],
        "series_id string, datetime string, nat_demand double")


def test_clean_and_report(untidy):
    df = quality.parse_time(quality.rename_raw(untidy), strict=False)
    assert df.columns == ["series_id", "timestamp", "load"]
    nulls = {r["column"]: (r["missing_count"], r["missing_percent"]) for r in quality.null_report(df).collect()}
    assert nulls["load"][0] == 2 and nulls["timestamp"][0] == 2 and nulls["series_id"] == (0, 0.0)
    assert quality.duplicate_times(df).first()["n_duplicates"] == 2  # one time, one null
    good, bad = quality.split_rejects(df)
    assert (good.count(), bad.count()) == (4, 2)
    assert [str(r["timestamp"]) for r in quality.missing_times(good).collect()] == ["2024-01-01 02:00:00"]
    assert quality.sort_by_time(df).collect()[-1]["timestamp"] is None
    assert quality.collapse_times(good, {"load": "avg"}).where("load = 2.5").count() == 1


def test_strict_times_raise(untidy):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        quality.parse_time(quality.rename_raw(untidy)).collect()


def test_validation(spark):
    df = series(spark, range(30)).unionByName(series(spark, range(5), "b"))
    short = quality.violations(df, ["load"], 24).collect()
    assert [(r["series_id"], r["rule"]) for r in short] == [("b", "too_few_rows")]
    with pytest.raises(InputError, match="need at least 24"):
        quality.validate(df, ["load"], 24)
    with pytest.raises(InputError, match="missing required columns.*lag_1.*present columns"):
        quality.validate(df, FEATURE_COLUMNS, 24)
    with pytest.raises(InputError, match="0 rows"):
        quality.validate(df.limit(0), ["load"], 24)
    assert quality.validate(df, ["load"], 5) is df


def test_profile_and_types(spark):
    row = quality.profile(series(spark, range(30))).first()
    assert (row["n_rows"], row["n_columns"]) == (30, 5)
    assert [r["type"] for r in quality.column_types(series(spark, [1.0])).orderBy("position").collect()][:2] == [
        "string", "timestamp"]
