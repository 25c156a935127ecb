import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import noisy, pdf, series
from tidewatt import session
from tidewatt.errors import ArtefactError, WindowError
from tidewatt.functions import severity
from tidewatt.operators import anomaly, axis, features, prepare
from tidewatt.schema import DETECTOR_COLUMNS
from tidewatt.sources import artefacts


@pytest.fixture(scope="module")
def table(spark):
    loads = noisy(700)
    loads[600:606] += 150
    df = series(spark, loads).unionByName(series(spark, noisy(700, 4), "b"))
    return features.load_features(df, gapless=True).withColumn("is_holiday", F.lit(0)).persist()


def matrix(table, name):
    return pdf(table.where(F.col("series_id") == name), "timestamp")[DETECTOR_COLUMNS].to_numpy(float)


def scale(x, fit):
    low, high = fit.min(0), fit.max(0)
    return (x - low) / np.where(high == low, 1, high - low)


def cut_windows(x, stride):
    return np.array([x[s:s + 24] for s in range(0, len(x) - 23, stride)])


@pytest.mark.parametrize("stride", [24, 5])
def test_mean_profile_matches_numpy(table, stride):
    detector = anomaly.fit_detector(table, stride=stride, filter_normal=False)
    got = pdf(anomaly.detect(table, detector, stride=stride), "series_id", "window_id")
    limits = {r["series_id"]: r for r in detector.threshold.collect()}
    for name in ("a", "b"):
        x = matrix(table, name)
        w = cut_windows(scale(x, x), stride)
        errors = np.abs(w - w.mean(0)).mean((1, 2))
        mine = got[got["series_id"] == name]
        assert np.allclose(mine["error"], errors)
        assert np.isclose(limits[name]["threshold"], np.quantile(errors, 0.99))
        assert np.isclose(limits[name]["std"], errors.std()) and np.isclose(limits[name]["p95"], np.quantile(errors, 0.95))
        assert (mine["is_anomaly"] == (errors > np.quantile(errors, 0.99))).all()


def test_filter_removes_far_rows_before_fitting(table):
    detector = anomaly.fit_detector(table)
    x = matrix(table, "a")
    mean, std, load = (x[:, DETECTOR_COLUMNS.index(c)] for c in ("rolling_mean_24", "rolling_std_24", "load"))
    kept = x[np.abs(load - mean) <= 3 * std]
    assert len(kept) < len(x)
    assert np.isclose(detector.scaler.where("series_id = 'a'").first()["max_load"], kept[:, -1].max())


def test_linear_autoencoder_matches_numpy(table):
    detector = anomaly.fit_detector(table, reconstruction="pca", k=8, filter_normal=False)
    got = pdf(anomaly.detect(table, detector), "series_id", "window_id")
    parts = {n: scale(matrix(table, n), matrix(table, n)) for n in ("a", "b")}
    train = np.concatenate([cut_windows(p, 1).reshape(-1, 408) for p in parts.values()])
    mean = train.mean(0)
    _, vectors = np.linalg.eigh(np.cov(train.T))
    top = vectors[:, -8:]
    for name, p in parts.items():
        x = cut_windows(p, 24).reshape(-1, 408) - mean
        errors = np.abs(x - x @ top @ top.T).mean(1)
        assert np.allclose(got.loc[got["series_id"] == name, "error"], errors, atol=1e-8)
    # the disturbed day stands out
    worst = got.loc[got["error"].idxmax()]
    assert worst["series_id"] == "a" and worst["severity"] != "normal"


def test_too_few_windows_for_the_components(table):
    with pytest.raises(WindowError, match="cannot give 32 components"):
        anomaly.fit_detector(table.where("timestamp < '2024-03-10'"), reconstruction="pca", fit_stride=24)


def test_any_model_can_score(table):
    rows = prepare.windows(axis.with_position(table.select("series_id", "timestamp", "load")), ["load"])

    def doubles():
        return lambda x: (x * 2).reshape(len(x), -1)

    scored = anomaly.score_windows(rows, doubles, (24, 1))
    row = scored.first()
    assert np.allclose(np.array(row["prediction"]), np.array(row["cells"]) * 2)
    error = scored.select(anomaly.reconstruction_error().alias("e")).first()["e"]
    assert np.isclose(error, np.abs(np.array(row["cells"])).mean())


def test_severity_rules(spark):
    errors = [1.0, 1.24, 1.25, 1.74, 1.75, float("nan")]
    df = spark.createDataFrame([(e,) for e in errors], "e double")
    level = severity.severity_by_excess(F.col("e"), F.lit(1.0))
    assert [r[0] for r in df.select(level).collect()] == ["normal", "low", "medium", "medium", "high", "normal"]
    sigma = severity.severity_by_sigma(F.col("e"), F.lit(1.0), F.lit(0.25))
    assert [r[0] for r in df.select(sigma).collect()] == ["normal", "low", "medium", "high", "high", "normal"]
    assert [r[0] for r in df.select(severity.is_above("e", F.lit(1.0))).collect()] == [False, True, True, True, True, False]


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1.0, False, "normal"), ("a", 2.0, True, "low"), ("a", 9.0, True, "high")],
                               "series_id string, error double, is_anomaly boolean, severity string")
    df = df.withColumn("threshold", F.lit(1.5)).withColumn("split", F.lit("test"))
    row = anomaly.anomaly_summary(df).first()
    assert (row["n_windows"], row["n_anomalies"], row["anomaly_rate"]) == (3, 2, 66.67)
    assert anomaly.severity_counts(df).first().asDict() == {"series_id": "a", "normal": 1, "low": 1, "medium": 0, "high": 1}
    assert np.isclose(anomaly.error_summary(df).first()["std_error"], np.std([1, 2, 9]))
    largest = anomaly.fit_threshold(df, method="max_buffer").first()
    assert np.isclose(largest["threshold"], 9.45) and largest["method"] == "max_buffer"


@pytest.mark.parametrize("kind", ["profile", "pca"])
def test_saved_detector_scores_the_same(spark, table, tmp_path, kind):
    detector = anomaly.fit_detector(table, reconstruction=kind, k=4)
    root = str(tmp_path / "detector")
    with pytest.raises(ArtefactError) as missing:
        artefacts.load_detector(spark, root)
    assert all(label in str(missing.value) for label in artefacts.DETECTOR_PARTS)
    assert not artefacts.models_ready(spark, root, root)
    artefacts.save_detector(spark, detector, root)
    again = anomaly.detect(table, artefacts.load_detector(spark, root))
    a, b = (pdf(d.select("series_id", "window_id", "error"), "series_id", "window_id")
            for d in (anomaly.detect(table, detector), again))
    assert np.allclose(a["error"], b["error"])


@pytest.mark.parametrize("length, stride, width, n", [(4, 1, 3, 50), (24, 1, 2, 60), (5, 3, 2, 41), (6, 1, 2, 6), (6, 1, 2, 5)])
def test_products_without_windows(length, stride, width, n):
    rows = np.random.default_rng(n).normal(size=(n, width))
    cells = np.array([rows[k:k + length].reshape(-1) for k in range(0, n - length + 1, stride)]).reshape(-1, length * width)
    count, sums, products = anomaly.window_products(rows, length, stride)
    assert count == len(cells) and np.allclose(sums, cells.sum(0)) and np.allclose(products, cells.T @ cells)
    rows[n // 2, 0] = np.nan
    whole = cells[[not np.isnan(rows[k:k + length]).any() for k in range(0, n - length + 1, stride)]]
    count, sums, products = anomaly.window_products(rows, length, stride)
    assert count == len(whole) and np.allclose(products, whole.T @ whole)


@pytest.mark.parametrize("stride, chunk", [(1, 4096), (1, 50), (7, 64)])
def test_components_from_rows_equal_those_from_windows(spark, stride, chunk):
    rng = np.random.default_rng(3)
    data = [(s, t, *map(float, rng.normal(size=2) * [3, 1] + np.sin(t / 4))) for s in "ab" for t in range(230 if s == "a" else 90)]
    rows = spark.createDataFrame(data, "series_id string, pos long, x double, y double")
    n = F.when(F.col("series_id") == "a", 230).otherwise(90).cast("long")
    rows = rows.withColumns({"n": n, "timestamp": F.timestamp_seconds(F.col("pos") * 3600)})
    made = anomaly.fit_autoencoder_rows(rows, 3, ["x", "y"], length=8, stride=stride, chunk_rows=chunk)
    want = anomaly.fit_autoencoder(prepare.windows(rows, ["x", "y"], length=8, stride=stride), 3)
    assert np.allclose(made.mean, want.mean)
    assert np.allclose(made.components @ made.components.T, want.components @ want.components.T, atol=1e-6)
    with pytest.raises(WindowError):
        anomaly.fit_autoencoder_rows(rows.where("pos < 7"), 3, ["x", "y"], length=8)


def test_scoring_needs_one_join(table):
    split = prepare.chrono_split(table, gapless=True).persist()
    detector = anomaly.fit_detector(split.where("split = 'train'").drop("pos", "n", "split", "split_pos", "split_n"))
    flagged = anomaly.detect(split.drop("split", "split_pos", "split_n"), detector, positioned=True)
    text = flagged._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert sum(line.lstrip(" +-:").startswith("Join") for line in text.splitlines()) == 1
    parts = (detector.scaler, detector.profile, None, ["series_id"])
    slow = anomaly.flag_windows(anomaly.window_errors(split, parts, ["series_id"]), detector.threshold)
    got, want = (pdf(d, "series_id", "window_id") for d in (flagged, slow))
    assert np.allclose(got["error"], want["error"]) and (got[["is_anomaly", "severity"]] == want[["is_anomaly", "severity"]]).all(axis=None)


def test_detector_by_block_equals_the_other_and_leaves_no_copies(spark, folder, monkeypatch, tmp_path):
    from tidewatt.plans import catalogue, driver_loads

    staged = prepare.chrono_split(driver_loads.event_features(spark, folder, "user_id"), gapless=True).persist()
    train = staged.where("split = 'train'").drop("pos", "n", "split", "split_pos", "split_n")
    want = anomaly.detect(staged.drop("split", "split_pos", "split_n"), anomaly.fit_detector(train), positioned=True)
    want = pdf(want.select("series_id", "window_id", "end_ts", "error", "is_anomaly"), "series_id", "window_id")
    monkeypatch.setattr(axis, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(axis, "TASK_ROWS", 3000)
    monkeypatch.setattr(session, "scratch_root", lambda spark: f"file://{tmp_path}")
    got = pdf(catalogue._scored(spark, folder, "user_id")[0].select(*want.columns), "series_id", "window_id")
    assert len(got) and got.drop(columns="error").equals(want.drop(columns="error")) and np.allclose(got["error"], want["error"])
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    # the rows lie there once: neither split rows nor training rows are left
    assert [x for x in left if x in ("hourly", "features", "split", "train-rows", "train-errors")] == ["features"]
