"""Load series made from the given tables.

``events`` counted by the hour stand in for hourly meters, one series per
event type or per user; ``orders`` by the day are one long series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import holiday_table
from ..operators import axis
from ..operators.features import WEEK_ROWS, load_features
from ..schema import DAY, SERIES, TIME
from ..session import cut, prepare_session, stage, staged

FILL = {"load": 0.0, "temperature": 0.0, "humidity": 0.0}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare_session(spark).read.parquet(f"{folder}/{name}.parquet")


def _series(df: DataFrame, key: str, time: str, unit: str, value: str) -> DataFrame:
    return (
        df.groupBy(F.col(key).cast("string").alias("series_id"),
                   F.date_trunc(unit, F.col(time).cast("timestamp")).alias(TIME))
        .agg(
            F.round(F.sum(value), 6).alias("load"),
            F.round(F.avg(value), 6).alias("temperature"),
            F.count(F.lit(1)).cast("double").alias("humidity"),
        )
    )


def hourly_events(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    """One row per (series, hour) with events; hours without are absent."""
    return _series(table(spark, folder, "events"), key, "ts", "hour", "value")


def written_hourly(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    """The hourly table, written for jobs that pass over it more than once.

    It is far smaller than the events, which are then scanned only once.
    """
    return stage(hourly_events(spark, folder, key), "hourly")


def dense_events(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    """Every hour of the whole table for every series, absent hours as 0."""
    hourly = written_hourly(spark, folder, key)
    bounds = axis.global_bounds(axis.series_bounds(hourly))
    return axis.densify(hourly, fill=FILL, bounds=bounds)


def dense_events_since(
    spark: SparkSession, folder: str, key: str = "event_type", since: str | None = None, steps: int | None = None,
) -> DataFrame:
    """The end of ``dense_events``: from the hour ``since`` on, or the last ``steps`` hours.

    The range and the names of the series are read first, a column each; the
    time filter then reaches the scan and only this end is put on an axis.
    """
    events = table(spark, folder, "events")
    first, last = events.agg(F.min(F.date_trunc("hour", "ts")), F.max(F.date_trunc("hour", "ts"))).first()
    begin, end = (F.lit(None if t is None else str(t)).cast("timestamp") for t in (first, last))
    wanted = F.lit(since).cast("timestamp") if steps is None else axis.shift_time(end, F.lit(1 - steps))
    begin = F.greatest(begin, wanted)
    names = events.select(F.col(key).cast("string").alias("series_id")).distinct()
    recent = events.where(F.col("ts") >= begin.cast(events.schema["ts"].dataType))
    hourly = _series(recent, key, "ts", "hour", "value")
    return axis.densify(hourly, fill=FILL, bounds=names.withColumns({"first_ts": begin, "last_ts": end}))


def dense_orders(spark: SparkSession, folder: str, key: str | None = None) -> DataFrame:
    """Order value by day, absent days as 0: one series, or one for each value of ``key``."""
    orders = table(spark, folder, "orders")
    orders = orders.withColumn("series", F.col(key) if key else F.lit("orders"))
    daily = _series(orders, "series", "o_orderdate", "day", "o_totalprice")
    return axis.densify(stage(daily, "daily"), step=DAY, fill=FILL)


def event_features(spark: SparkSession, folder: str, key: str = "event_type", **options) -> DataFrame:
    return load_features(
        dense_events(spark, folder, key), holiday_table(spark, 2023, 2025), keys=SERIES, gapless=True, **options
    )


def blocked_features(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    """``event_features``, written by (series, block) with ``axis.BLOCK``: passes over them shuffle no rows.

    The absent hours are put in where the features are made, so they are not shuffled either.
    """
    with staged(hourly_events(spark, folder, key), "hourly") as hourly:
        bounds = cut(axis.global_bounds(axis.series_bounds(hourly)))
        parts = axis.dense_parts(bounds)
        chunks = axis.dense_chunks(hourly, bounds, parts, fill=FILL, back=WEEK_ROWS)
        made = load_features(chunks, holiday_table(spark, 2023, 2025), chunked=True, parts=parts)
        return stage(made, "features", **axis.dealing(made))


def order_features(spark: SparkSession, folder: str, key: str | None = None) -> DataFrame:
    return load_features(
        dense_orders(spark, folder, key), holiday_table(spark, 1994, 2002), step=DAY, gapless=True
    )
