import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import START, noisy, pdf, series
from tidewatt.errors import InputError
from tidewatt.operators import features, forecast, prepare, report
from tidewatt.schema import FEATURE_COLUMNS

N = 1600


@pytest.fixture(scope="module")
def table(spark):
    df = series(spark, noisy(N)).unionByName(series(spark, noisy(N, 1) * 3, "b"))
    rows = features.load_features(df, gapless=True).withColumn("is_holiday", F.lit(0))
    return prepare.chrono_split(rows).persist()


@pytest.fixture(scope="module")
def fitted(table):
    return forecast.fit_forecaster(table, regressor=forecast.estimator(loss="squaredError"))


def test_naive_repeats_the_week_before(spark):
    got = pdf(forecast.seasonal_naive(series(spark, noisy(300)), 168), "step")
    assert got["step"].tolist() == list(range(1, 169))
    assert np.allclose(got["yhat"], np.round(noisy(300)[-168:], 2), atol=0.0051)
    gaps = got["ts"].diff().dropna().unique()
    assert len(gaps) == 1 and got["ts"].iloc[0] == START + pd.Timedelta(hours=300)
    assert forecast.seasonal_naive(series(spark, noisy(100)), 24).isEmpty()


def test_served_values_are_rounded_and_not_negative(spark):
    loads = [-3.2, 5.129] + [1.0] * 166
    got = pdf(forecast.seasonal_naive(series(spark, loads), 24), "step")
    assert got["yhat"].tolist()[:3] == [0.0, 5.13, 1.0]
    band = pdf(forecast.forecast_band(forecast.seasonal_naive(series(spark, loads), 24), 2.0), "step")
    assert band["lower"].min() == 0.0 and band["upper"].iloc[0] == 2.0


def test_reference_weather_reuses_the_same_day(spark):
    got = pdf(forecast.seasonal_reference(series(spark, noisy(200)), ["temperature"]), "step")
    day = noisy(200)[-168:-144] * 0.5
    assert np.allclose(got["temperature"], np.tile(day, 7))


def test_training_frame_matches_slices(spark, table):
    scaler = forecast.fit_scaler(table)
    got = forecast.training_frame(table.where("series_id = 'a'"), scaler, chunk_rows=300)
    sizes = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    n = N - 168
    a, b = int(n * 0.7), int(n * 0.85)
    assert sizes == {s: 24 * (k - 191) for s, k in (("train", a), ("val", b - a), ("test", n - b)) if k > 191}
    limits = scaler.where("series_id = 'a'").first()
    values = (noisy(N)[168:] - limits["min_load"]) / (limits["max_load"] - limits["min_load"])
    origin = START + pd.Timedelta(hours=168 + 400)
    one = pdf(got.where(F.col("origin_ts") == F.lit(str(origin))), "step")
    assert np.allclose(one["label"], values[401:425])
    assert np.allclose(one["load_24_before"], values[377:401])
    assert np.allclose(one["load_168_before"], values[233:257])
    assert (one["ts"] == [origin + pd.Timedelta(hours=h) for h in range(1, 25)]).all()


def chained(loads, start, fitted, scaler):
    """The chained forecast by hand for one series."""
    model = fitted.model.stages[-1]
    weights, bias = model.coefficients.toArray(), model.intercept
    low, high = scaler["min_load"], scaler["max_load"]
    history, out, now = list(loads), [], start + pd.Timedelta(hours=len(loads) - 1)
    week = list(loads[-168:])

    def cycles(t):
        return [f(2 * np.pi * v / p) for v, p in ((t.hour, 24), (t.dayofweek, 7), (t.month, 12)) for f in (np.sin, np.cos)]

    for day in range(7):
        src = loads[-1] if day == 0 else loads[-168:][23]
        ddof = 1 if day == 0 else 0
        row = [src * 0.5, src * 0.25, float(now.dayofweek >= 5), 0.0, *cycles(now),
               history[-2], history[-25], history[-169], np.mean(history[-24:]),
               np.std(history[-24:], ddof=ddof), np.mean(history[-168:])]
        scaled = [(v - scaler[f"min_{c}"]) / ((scaler[f"max_{c}"] - scaler[f"min_{c}"]) or 1.0)
                  for c, v in zip(FEATURE_COLUMNS, row)]
        new = []
        for step in range(1, 25):
            t = now + pd.Timedelta(hours=step)
            refs = [(history[len(history) - k + step - 1] - low) / (high - low) for k in (24, 48, 168)]
            yhat = bias + np.dot(weights, [*scaled, *cycles(t), *refs])
            new.append(max(0.0, round(yhat * (high - low) + low, 2)))
        history += new
        out += new
        now += pd.Timedelta(hours=24)
    assert len(week) == 168
    return out


def test_extended_forecast_matches_a_hand_made_chain(spark, table, fitted):
    got = forecast.run_extended_forecast(table, fitted)
    assert got.columns == ["series_id", "origin_ts", "step", "ts", "yhat", "label"]
    for name, seed, factor in (("a", 0, 1), ("b", 1, 3)):
        mine = pdf(got.where(F.col("series_id") == name), "step")
        assert mine["step"].tolist() == list(range(1, 169))
        assert len(mine["origin_ts"].unique()) == 1
        assert (mine["ts"] - mine["origin_ts"] == pd.to_timedelta(mine["step"], unit="h")).all()
        want = chained(noisy(N, seed) * factor, START, fitted, fitted.scaler.where(F.col("series_id") == name).first())
        assert np.abs(mine["yhat"] - want).max() < 0.05
    day = pdf(forecast.run_forecast(table, fitted), "series_id", "step")
    first = pdf(got.where("step <= 24"), "series_id", "step")
    pd.testing.assert_series_equal(day["yhat"], first["yhat"])


def test_chunk_windows_shuffle_by_chunk_behind_a_shuffled_parameter_join(spark, table, fitted, monkeypatch):
    monkeypatch.setattr(forecast.axis, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = forecast.origin_frame(table, fitted.scaler)
        # without the plan of the cached input
        text = frame._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
        assert "BroadcastHashJoin" not in text
        below = text.split("Window [", 1)[1]
        assert re.search(r"Exchange hashpartitioning\((.*)", below).group(1).startswith("series_id")
        assert re.search(r"Exchange hashpartitioning\([^)]*_chunk", below).start() < below.index("Join")
        assert frame.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_every_day_of_the_chain_has_the_same_plan(table, fitted, monkeypatch):
    joins = []

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        return done(df)

    done = forecast.cut
    monkeypatch.setattr(forecast, "cut", counted)
    forecast.run_extended_forecast(table, fitted)
    assert len(joins) == 14 and set(joins[1::2]) == {1} and set(joins[2::2]) == {1}


def test_naive_rows_equal_the_joined_pairs(table):
    actual, predicted = forecast.naive_pairs(table)
    joined = forecast.pair_forecasts(actual, predicted, ["series_id", "split"])
    for rows in (4096, 211):
        got = forecast.naive_pair_rows(table, chunk_rows=rows)
        assert got.count() == joined.count() > 0 and got.select(joined.columns).exceptAll(joined).isEmpty()


def test_forecast_without_a_time_axis(spark, table, fitted):
    plain = table.withColumn("row", F.col("pos")).drop("timestamp")
    got = pdf(forecast.run_extended_forecast(plain, fitted, time="row", has_time=False), "series_id", "step")
    assert got["label"].tolist()[:2] == ["T+1h", "T+2h"] and got["ts"].isna().all() and len(got) == 336


def test_too_short_series_raise(table, fitted):
    with pytest.raises(InputError, match="need at least 192"):
        forecast.run_extended_forecast(table.where("pos < 180"), fitted)
    with pytest.raises(InputError, match="missing"):
        forecast.run_forecast(table.drop("lag_1"), fitted)


def test_fitted_beats_naive_on_a_noisy_cycle(table, fitted):
    held = table.where("split = 'test'")
    mine = report.forecast_metrics(forecast.predict_split(held, fitted)).first()
    actual, predicted = forecast.naive_pairs(held)
    naive = report.forecast_metrics(forecast.pair_forecasts(actual, predicted, ["series_id", "split"])).first()
    assert mine["n_pairs"] == naive["n_pairs"] > 0 and mine["mae"] < naive["mae"]


def test_metrics(spark):
    pairs = spark.createDataFrame([(10.0, 8.0), (0.0, -5.0), (4.0, 8.0)], "y double, yhat double")
    row = report.forecast_metrics(pairs).first()
    assert np.isclose(row["mae"], 2.0) and np.isclose(row["rmse"], np.sqrt(20 / 3))
    assert np.isclose(row["smape"], (4 / 18 + 0 + 8 / 12) / 3 * 100)


def test_history(spark):
    rows = [("r", 1, "val_loss", 3.0), ("r", 2, "val_loss", 1.0), ("r", 3, "val_loss", 1.0)]
    best = report.history_best(spark.createDataFrame(rows, "run_id string, epoch int, metric string, value double")).first()
    assert (best["epochs"], best["best_value"], best["best_epoch"]) == (3, 1.0, 2)
