import numpy as np
import pandas as pd
import pytest

from frames import noisy, pdf, series
from tidewatt.functions.calendar import holiday_table
from tidewatt.operators import features
from tidewatt.schema import FEATURE_COLUMNS


def expected(loads):
    s = pd.Series(loads, dtype=float)
    return pd.DataFrame({
        "lag_1": s.shift(1), "lag_24": s.shift(24), "lag_168": s.shift(168),
        "rolling_mean_24": s.rolling(24).mean(), "rolling_std_24": s.rolling(24).std(),
        "rolling_mean_168": s.rolling(168).mean(),
    })


@pytest.mark.parametrize("chunk_rows", [4096, 200, 97, 10])
@pytest.mark.parametrize("gapless", [True, False])
def test_features_match_pandas_in_any_chunking(spark, chunk_rows, gapless):
    loads = noisy(400)
    got = pdf(features.load_features(series(spark, loads), gapless=gapless, drop_incomplete=False,
                                     chunk_rows=chunk_rows), "timestamp")
    want = expected(loads)
    pd.testing.assert_frame_equal(got[want.columns], want, atol=1e-9, check_dtype=False)


def test_counting_series_drops_168_rows(spark):
    got = pdf(features.load_features(series(spark, range(1, 201)), gapless=True), "timestamp")
    assert len(got) == 32 and got["load"].iloc[0] == 169
    assert np.allclose(got["rolling_std_24"], 7.0710678)
    assert set(FEATURE_COLUMNS) <= set(got.columns)


def test_missing_value_empties_its_windows(spark):
    df = series(spark, noisy(260)).selectExpr(
        "series_id", "timestamp", "if(timestamp = '2024-03-05 00:00:00', null, load) AS load")
    loads = noisy(260)
    loads[96] = np.nan
    got = pdf(features.rolling_stats(df, gapless=True), "timestamp")
    want = expected(loads)[["rolling_mean_24", "rolling_std_24", "rolling_mean_168"]]
    pd.testing.assert_frame_equal(got[want.columns], want, atol=1e-9, check_dtype=False)


def test_lags_count_rows_when_hours_are_missing(spark):
    got = pdf(features.lags(series(spark, range(60), skip=[10, 11, 12]), (1, 24), chunk_rows=30), "timestamp")
    s = got["load"]
    pd.testing.assert_series_equal(got["lag_24"], s.shift(24), check_names=False)
    pd.testing.assert_series_equal(got["lag_1"], s.shift(1), check_names=False)


def test_trailing_statistics_shrink_and_use_population_deviation(spark):
    got = pdf(features.trailing_stats(series(spark, noisy(50)), gapless=True, chunk_rows=20), "timestamp")
    s = pd.Series(noisy(50))
    want = s.rolling(24, min_periods=1).std(ddof=0)
    assert np.allclose(got["trailing_std_24"], want) and got["trailing_std_24"].iloc[0] == 0
    assert np.allclose(got["trailing_mean_24"], s.rolling(24, min_periods=1).mean())


def test_calendar(spark):
    got = pdf(features.calendar_features(series(spark, range(24 * 8)), None), "timestamp")
    t = got["timestamp"].dt
    assert (got["day_of_week"] == t.dayofweek).all() and (got["is_weekend"] == (t.dayofweek >= 5)).all()
    assert np.allclose(got["month_sin"], np.sin(2 * np.pi * t.month / 12))
    assert np.allclose(got["dayofweek_cos"], np.cos(2 * np.pi * t.dayofweek / 7))
    assert set(got["is_holiday"]) == {0}


def test_holidays(spark):
    rows = {str(r["date"]): r["name"] for r in holiday_table(spark, 2022, 2024).collect()}
    assert rows["2023-04-07"] == "Good Friday" and rows["2024-02-13"] == "Carnival"
    assert rows["2024-03-29"] == "Good Friday"
    assert rows["2023-01-02"] == "New Year's Day (observed)" and "2023-01-01" in rows
    assert holiday_table(spark, 2023, 2023, observed=False).count() == 12


def test_features_from_a_start_equal_the_whole(spark):
    df = series(spark, noisy(500))
    whole = features.load_features(df, gapless=True).where("timestamp >= '2024-03-15 05:00:00'")
    part = features.load_features_from(df, "2024-03-15 05:00:00")
    a, b = pdf(whole, "timestamp"), pdf(part, "timestamp")
    pd.testing.assert_frame_equal(a, b, atol=1e-9)
