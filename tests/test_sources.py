import pytest

from frames import noisy, pdf, series
from tidewatt.errors import InputError, WindowError
from tidewatt.plans import training
from tidewatt.sources import artefacts, tables
from tidewatt.operators import features, prepare


def test_raw_csv(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("nat_demand,datetime,T2M_toc,note\n2.5,2024-01-01 01:00:00,20,x\n1.5,2024-01-01 00:00:00,,y\n")
    df = tables.clean_raw(tables.read_raw_csv(spark, str(path)))
    assert df.columns == ["load", "timestamp", "temperature", "note"]
    rows = df.collect()
    assert [r["load"] for r in rows] == [1.5, 2.5] and rows[0]["temperature"] is None


def test_feature_csv_keeps_unreadable_times_last(spark, tmp_path):
    path = tmp_path / "features.csv"
    path.write_text("timestamp,load\nnever,1\n2024-01-01 01:00:00,2\n2024-01-01 00:00:00,3\n")
    assert [r["load"] for r in tables.read_feature_csv(spark, str(path)).collect()] == [3.0, 2.0, 1.0]
    path.write_text("load,lag_1\n1,2\n")
    assert tables.read_feature_csv(spark, str(path)).columns == ["load", "lag_1"]


def test_parquet_by_series(spark, tmp_path):
    path = str(tmp_path / "t")
    df = series(spark, noisy(30)).unionByName(series(spark, noisy(30), "b"))
    tables.write_parquet(df, path, ["series_id"])
    back = tables.read_parquet(spark, path)
    assert back.select(*df.columns).exceptAll(df).isEmpty()
    plan = back.where("series_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(series_id" in plan


def test_records_and_runs(spark, tmp_path):
    path = str(tmp_path / "threshold")
    artefacts.write_record(spark, {"threshold": 0.5, "method": "p99"}, path)
    row = artefacts.read_record(spark, path, "threshold double, method string").first()
    assert (row["threshold"], row["method"]) == (0.5, "p99")
    runs = str(tmp_path / "runs")
    for run in ("one", "two"):
        artefacts.log_run(spark, runs, run, "metric", {"mae": 1.25, "rmse": 2})
    assert artefacts.read_runs(spark, runs).count() == 4


def test_search_and_training_job(spark, tmp_path):
    rows = features.load_features(series(spark, noisy(1600)), gapless=True)
    split = prepare.chrono_split(rows)
    found = pdf(training.tune_forecaster(split, trials=3, origin_stride=4), "val_mae")
    assert sorted(found["trial"]) == [0, 1, 2] and found["val_mae"].is_monotonic_increasing
    assert len({str(p) for p in training.search_points(20)}) == 20
    made = training.train_forecaster(rows, run_search=False, origin_stride=4, save_to=str(tmp_path), run_id="r1")
    metrics = {r["split"]: r["mae"] for r in made["metrics"].collect()}
    assert set(metrics) == {"val", "test"}
    logged = {r["key"] for r in artefacts.read_runs(spark, f"{tmp_path}/runs").collect()}
    assert {"test_mae", "test_rmse", "test_smape"} <= logged
    again = artefacts.load_forecaster(spark, f"{tmp_path}/forecaster")
    assert again.keys == ["series_id"] and again.model.stages[-1].coefficients.size > 0
    with pytest.raises(InputError, match="missing"):
        training.train_forecaster(rows.drop("lag_1"))
    with pytest.raises(WindowError, match="val data too short"):
        training.train_forecaster(rows.limit(900))


def test_validation_error_of_a_trial_is_its_model_error(spark):
    """The one-pass score of a trial equals scoring it the ordinary way."""
    from tidewatt.operators import forecast, report

    split = prepare.chrono_split(features.load_features(series(spark, noisy(1600)), gapless=True))
    found = {r["trial"]: r["val_mae"] for r in training.tune_forecaster(split, trials=2, origin_stride=6).collect()}
    point = training.search_points(2)[1]
    fitted = forecast.fit_forecaster(split, regressor=forecast.estimator(**point), origin_stride=6)
    val = forecast.training_frame(split.where("split = 'val'"), fitted.scaler, origin_stride=6)
    scored = forecast._load_scaled(fitted.model.transform(val), fitted, forecast.unscale, "label", "y")
    scored = forecast._load_scaled(scored, fitted, forecast.unscale, "scaled_yhat", "yhat")
    assert abs(report.forecast_metrics(scored).first()["mae"] - found[1]) < 1e-6
