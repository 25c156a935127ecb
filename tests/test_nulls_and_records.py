"""Rows that must not be lost or shifted: record files of several parts, null cells, null loads."""

import datetime

import pytest

from tidewatt.operators import anomaly, forecast, prepare, quality
from tidewatt.plans import training
from tidewatt.sources import artefacts


def test_every_part_file_is_read(spark, tmp_path):
    path = str(tmp_path / "history")
    artefacts.write_frame_record(spark.range(42).repartition(4), path)
    assert artefacts.read_record(spark, path, "id long").count() == 42
    artefacts.write_record(spark, {"threshold": 0.5}, str(tmp_path / "one"))
    assert [r.threshold for r in artefacts.read_record(spark, str(tmp_path / "one")).collect()] == [0.5]


def test_search_ends():
    assert len(training.search_points(100)) == 100
    with pytest.raises(ValueError, match="100 points"):
        training.search_points(101)


def hours(n):
    return [datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i) for i in range(n)]


def test_null_cell_leaves_no_error(spark):
    rows = [("s", t, i, 4, v) for i, (t, v) in enumerate(zip(hours(4), [1.0, None, 3.0, 4.0]))]
    scaled = spark.createDataFrame(rows, "series_id string, timestamp timestamp, pos long, n long, a double")
    profile = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 1.0)], "series_id string, offset int, profile_a double")
    out = anomaly.profile_errors(scaled, profile, ["a"], length=2, stride=2).orderBy("window_id").collect()
    assert [r.error for r in out] == [None, 2.5]


def test_unscored_windows_have_no_flag(spark):
    errors = spark.createDataFrame([("a", 0, 2.0), ("a", 1, None), ("a", 2, 0.5), ("a", 3, float("nan")), ("b", 0, 9.0)], "series_id string, window_id long, error double")
    limits = spark.createDataFrame([("a", 1.0, 0.5)], "series_id string, threshold double, std double")
    for rule in ("excess", "sigma"):
        flagged = anomaly.flag_windows(errors, limits, severity=rule).orderBy("series_id", "window_id")
        assert [(r.is_anomaly, r.severity) for r in flagged.collect()] == [
            (True, "high"), (None, None), (False, "normal"), (False, "normal"), (None, None)]
    summary = anomaly.anomaly_summary(flagged).orderBy("series_id").collect()
    assert [(r.n_windows, r.n_anomalies, r.n_unscored, r.anomaly_rate) for r in summary] == [(4, 1, 1, 33.33), (1, 0, 1, None)]
    assert [r.normal for r in anomaly.severity_counts(flagged).orderBy("series_id").collect()] == [2, 0]


def test_null_load_keeps_steps_aligned(spark):
    n = 200
    rows = [("s", "train", t, i, n, None if i == 180 else float(i)) for i, t in enumerate(hours(n))]
    frame = spark.createDataFrame(rows, "series_id string, split string, timestamp timestamp, split_pos long, split_n long, load double")
    actual, naive = forecast.naive_pairs(frame, horizon=24)
    origin = hours(n)[170]
    got = {r.step: r.y for r in actual.where(f"origin_ts = timestamp'{origin}'").collect()}
    assert got == {s: None if 170 + s == 180 else float(170 + s) for s in range(1, 25)}
    assert naive.count() == actual.count()


def test_what_is_set_aside_is_reported(spark):
    rows = [("a", t, 1.0) for t in hours(30)] + [("a", None, 1.0)] * 3 + [("b", t, 2.0) for t in hours(5)] + [("b", None, 2.0), (None, hours(1)[0], 3.0), (None, None, 3.0)]
    df = spark.createDataFrame(rows, "series_id string, timestamp timestamp, load double")
    usable, rejects = quality.set_aside(df, min_rows=10)
    assert usable.count() == 30 and usable.columns == df.columns
    found = {(r["series_id"], r["reason"]): r["n_rows"] for r in rejects.collect()}
    assert found == {("a", "null_time"): 3, ("b", "null_time"): 1, (None, "null_key"): 2, ("b", "too_few_rows"): 5}
    split, _ = prepare.split_usable(df, min_rows=10)
    assert split.count() == 30 and usable.count() + sum(found.values()) == df.count()
    assert quality.set_aside(df)[0].count() == 35 and quality.set_aside(df.limit(0), min_rows=3)[1].isEmpty()
