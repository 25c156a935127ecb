import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import pdf, series
from tidewatt.operators import axis
from tidewatt.session import stage


@pytest.mark.parametrize("block_rows, fan", [(4096, 4096), (10, 3), (1, 2)])
def test_positions_match_a_sort(spark, monkeypatch, block_rows, fan):
    monkeypatch.setattr(axis, "FAN", fan)
    gaps = set(np.random.default_rng(1).choice(200, 60, replace=False).tolist())
    df = series(spark, range(200), skip=gaps).unionByName(series(spark, range(37), "b"))
    got = pdf(axis.with_position(df, block_rows=block_rows), "series_id", "timestamp")
    for _, part in got.groupby("series_id"):
        assert part["pos"].tolist() == list(range(len(part)))
        assert set(part["n"]) == {len(part)}
    assert len(got) == 140 + 37


def test_positions_of_a_row_number_column(spark):
    df = spark.range(50).selectExpr("'a' AS series_id", "id * 3 AS row")
    got = axis.with_position(df, time="row", block_rows=7).toPandas()
    assert (got["pos"] * 3 == got["row"]).all()


@pytest.mark.parametrize("back, ahead, rows", [(0, 0, 10), (3, 0, 10), (0, 4, 10), (25, 11, 10)])
def test_chunks_hold_their_neighbours(spark, back, ahead, rows):
    df = spark.range(95).selectExpr("'a' AS series_id", "id AS pos")
    got = axis.with_chunks(df, F.col("pos"), back, ahead, rows).toPandas()
    assert sorted(got.loc[got["_own"], "pos"]) == list(range(95))
    for chunk in range(10):
        want = set(range(max(0, chunk * rows - back), min(95, chunk * rows + rows + ahead)))
        assert set(got.loc[got["_chunk"] == chunk, "pos"]) == want


def test_spine_in_two_strides(spark):
    df = series(spark, range(100)).unionByName(series(spark, range(3), "b"))
    full = axis.spine(axis.series_bounds(df), chunk_rows=7)
    assert full.exceptAll(df.select("series_id", "timestamp")).isEmpty() and full.count() == 103


def test_densify_fills_gaps_only(spark):
    df = series(spark, range(48), skip=[5, 6, 30]).unionByName(series(spark, range(4), "b", skip=[2]))
    got = pdf(axis.densify(df, fill={"load": 0.0}), "series_id", "timestamp")
    assert len(got) == 52 and got["load"].isna().sum() == 0
    assert got["temperature"].isna().sum() == 4
    whole = axis.densify(df, bounds=axis.global_bounds(axis.series_bounds(df)))
    assert whole.count() == 96


def test_last_rows(spark):
    df = series(spark, range(30)).unionByName(series(spark, range(5), "b"))
    got = axis.last_rows(df, 10).groupBy("series_id").agg(F.count("*"), F.min("load")).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == [("a", 10, 20.0), ("b", 5, 0.0)]


def test_attach_keeps_rows_without_parameters(spark, monkeypatch):
    df = series(spark, range(3)).unionByName(series(spark, range(2), "b"))
    params = spark.createDataFrame([("a", 7)], "series_id string, p int")
    for bound in (axis.BROADCAST_ROWS, 0):
        monkeypatch.setattr(axis, "BROADCAST_ROWS", bound)
        joined = axis.attach(df, params)
        assert joined.count() == 5 and joined.where("p = 7").count() == 3
        hinted = "ResolvedHint" in joined._jdf.queryExecution().analyzed().toString()
        assert hinted == (bound > 0)


@pytest.mark.parametrize("salts", [1, 32])
def test_salted_parameters_equal_broadcast_ones(spark, monkeypatch, salts):
    df = series(spark, range(50)).unionByName(series(spark, range(20), "b")).unionByName(series(spark, [1, 2], None))
    df = df.unionByName(df.limit(3)).withColumn("p_list", F.array("load", F.lit(None)))
    params = spark.createDataFrame([("a", 7, None), ("c", 1, 2.0)], "series_id string, p int, q double")
    want = axis.attach(df, params)
    monkeypatch.setattr(axis, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(axis, "SALTS", salts)
    got = axis.attach(df, params)
    assert got.columns == want.columns and got.count() == 75
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert axis.attach(df.limit(0), params).isEmpty() and axis.attach(df, params.limit(0)).where("p IS NULL").count() == 75


def test_time_shift_crosses_a_month_end(spark):
    df = spark.sql("SELECT timestamp '2024-02-28 20:00:00' AS t")
    assert df.select(axis.shift_time("t", F.lit(30)).cast("string")).first()[0] == "2024-03-01 02:00:00"
    assert pd.Timestamp(df.select(axis.from_tick(axis.tick("t"))).first()[0]) == pd.Timestamp("2024-02-28 20:00:00")


def test_gapless_positions_need_no_window(spark):
    df = series(spark, range(300)).unionByName(series(spark, range(37), "b"))
    got = axis.gapless_position(df)
    assert got.exceptAll(axis.with_position(df).select(got.columns)).isEmpty() and got.count() == 337
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("skip, again", [({5}, []), (set(), [7]), ({5}, [7]), ({1, 2}, [0, 3])])
def test_gaps_and_repeats_are_found(spark, skip, again):
    df = series(spark, range(10), skip=skip)
    for k in again:
        df = df.unionByName(series(spark, range(10), skip=set(range(10)) - {k}))
    with pytest.raises(axis.InputError, match="gaps or repeated"):
        axis.gapless_position(df)
    with pytest.raises(axis.InputError):
        axis.gapless_position(series(spark, range(10)).withColumn("timestamp", F.when(F.col("load") < 9, F.col("timestamp")).otherwise(F.expr("timestamp + interval 1 minute"))))


@pytest.mark.parametrize("chunk, back", [(4096, 168), (20, 0), (7, 30), (1, 3)])
def test_dense_chunks_are_the_chunks_of_the_dense_axis(spark, chunk, back):
    df = series(spark, range(60), skip={1, 2, 30, 31, 59}).unionByName(series(spark, range(9), "b", skip=range(8)))
    df = df.unionByName(df.where("load = 3")).unionByName(series(spark, [5, 6], None))  # a time twice, no series
    df = df.unionByName(series(spark, [7], start=pd.Timestamp("2024-03-01 05:30")))     # between the steps
    df = df.withColumn("load", F.when(F.col("load") != 40, F.col("load")))
    bounds = spark.createDataFrame(
        [("a", 4, 70), ("b", -3, 20), (None, 0, 5), ("c", 0, 30), ("d", 9, 3)], "series_id string, f int, l int")
    start = "timestamp '2024-03-01' + make_interval(0, 0, 0, 0, {}, 0, 0)"
    bounds = bounds.selectExpr("series_id", f"{start.format('f')} AS first_ts", f"{start.format('l')} AS last_ts")
    fill = {"load": 0.0}
    got = axis.dense_chunks(df, bounds, 3, fill=fill, back=back, chunk_rows=chunk)
    dense = axis.densify(df, bounds=bounds.where("first_ts <= last_ts"), fill=fill)
    want = axis.with_chunks(dense, axis.tick(), back=back, chunk_rows=chunk)
    # chunks that have no rows of their own are not made
    own = want.where("_own").select("series_id", "_chunk").distinct()
    same = (F.col("w.series_id").eqNullSafe(F.col("o.series_id"))) & (F.col("w._chunk") == F.col("o._chunk"))
    want = want.alias("w").join(own.alias("o"), same, "left_semi").select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


def shuffled_scans(df):
    """What is read below an exchange, by plan."""
    found, above = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, name) for d, name in above if d < depth] + [(depth, line.strip(" :+-"))]
        if "ReadSchema" in line and any(name.startswith("Exchange") for _, name in above):
            found.append(line.split("ReadSchema: ")[1])
    return found


def test_rows_staged_by_block_are_not_shuffled(spark, monkeypatch):
    df = series(spark, range(300)).unionByName(series(spark, range(37), "b"))
    chunked = axis.keep_block(axis.with_chunks(df, axis.tick(), chunk_rows=50), 4)
    rows = axis.drop_chunks(chunked)
    rows = stage(rows, "rows", **axis.dealing(rows))
    assert axis.dealing(rows) == {"by": ["series_id", axis.BLOCK], "parts": 4} and axis.dealing(df) == {}
    assert not spark.catalog.listTables()
    params = spark.createDataFrame([("a", 7)], "series_id string, p int")
    want = axis.attach(axis.with_position(df), params)
    monkeypatch.setattr(axis, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = axis.attach(axis.with_position(rows), params)
        read = shuffled_scans(got)
        assert read and not any("load" in columns for columns in read)
        got = got.select(want.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 337
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("limit, copies", [(1000, 2), (15, 6)])
def test_only_long_series_have_copies_of_their_parameters(spark, monkeypatch, limit, copies):
    df = series(spark, range(70)).unionByName(series(spark, range(15), "b"))
    params = spark.createDataFrame([("a", 7), ("b", 8)], "series_id string, p int")
    want = axis.attach(df, params)
    monkeypatch.setattr(axis, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(axis, "SALT_ROWS", limit)
    rows, copied = axis.salted(df, params, ["series_id"])
    assert copied.count() == copies and rows.count() == 85
    got = axis.attach(df, params)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
