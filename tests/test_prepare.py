import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import noisy, pdf, series
from tidewatt.errors import WindowError
from tidewatt.operators import axis, prepare


def placed(spark, n):
    return axis.with_position(series(spark, noisy(n)))


def brute_windows(values, length, stride):
    return [values[s:s + length] for s in range(0, len(values) - length + 1, stride)]


@pytest.mark.parametrize("n, length, stride", [
    (49, 24, 24), (49, 24, 1), (100, 24, 7), (100, 10, 30), (24, 24, 5), (23, 24, 24), (60, 3, 2)])
def test_windows_match_slices(spark, n, length, stride):
    df, values = placed(spark, n), noisy(n)
    want = brute_windows(values, length, stride)
    got = pdf(prepare.windows(df, ["load", "temperature"], length=length, stride=stride, chunk_rows=16), "window_id")
    assert got["window_id"].tolist() == list(range(len(want)))
    for cells, w in zip(got["cells"], want):
        assert np.allclose(np.array(cells).reshape(length, 2), np.column_stack([w, w * 0.5]))
    long = pdf(prepare.window_cells(df, length, stride), "window_id", "offset")
    assert np.allclose(long["load"], np.concatenate(want) if want else [])
    assert len(want) == max(0, (n - length) // stride + 1)


def test_too_short_for_a_window(spark):
    with pytest.raises(WindowError, match="need at least 24, got 23"):
        prepare.require_rows(placed(spark, 23), 24)
    prepare.require_rows(placed(spark, 24), 24)


@pytest.mark.parametrize("n, count", [(192, 1), (191, 0), (250, 59)])
def test_sequences(spark, n, count):
    values = noisy(n)
    got = pdf(prepare.sequences(placed(spark, n), ["load"], chunk_rows=50), "origin_pos")
    assert len(got) == count
    for i, row in got.iterrows():
        assert np.allclose(np.array(row["x"]).ravel(), values[i:i + 168])
        assert np.allclose(row["y"], values[i + 168:i + 192])


@pytest.mark.parametrize("n", [7, 20, 100, 552])
def test_split_by_position(spark, n):
    got = pdf(prepare.chrono_split(series(spark, range(n))), "timestamp")
    sizes = got.groupby("split").size()
    a, b = int(n * 0.70), int(n * 0.85)
    assert [sizes.get(s, 0) for s in ("train", "val", "test")] == [a, b - a, n - b]
    for _, part in got.groupby("split"):
        assert part["split_pos"].tolist() == list(range(len(part))) and set(part["split_n"]) == {len(part)}


def test_scaling(spark):
    train = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0)], "series_id string, x double, c double")
    params = prepare.fit_minmax(train, ["x", "c"])
    new = spark.createDataFrame([("a", 5.0, 5.0), ("a", 0.0, 6.0)], "series_id string, x double, c double")
    scaled = prepare.transform_minmax(new, params, ["x", "c"])
    assert sorted(map(tuple, scaled.select("x", "c").collect())) == [(-0.5, 1.0), (2.0, 0.0)]
    back = prepare.inverse_minmax(scaled, params, ["x", "c"])
    assert sorted(map(tuple, back.select("x", "c").collect())) == [(0.0, 6.0), (5.0, 5.0)]
    alone = prepare.fit_minmax(train, ["x"], keys=[])
    assert prepare.transform_minmax(new, alone, ["x"], keys=[]).agg(F.max("x")).first()[0] == 2.0


def test_normal_rows(spark):
    df = spark.createDataFrame([(10.0, 4.0, 2.0), (10.1, 4.0, 2.0), (-2.0, 4.0, 2.0)],
                               "load double, rolling_mean_24 double, rolling_std_24 double")
    assert sorted(r["load"] for r in prepare.normal_rows(df).collect()) == [-2.0, 10.0]
