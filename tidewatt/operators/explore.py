"""Profiles of a load series: calendar means, heatmap, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar
from ..schema import DAY_NAMES, SERIES, TARGET_COLUMN, TIME
from .axis import attach
from .quantiles import exact_quantiles


def with_calendar(df: DataFrame, time: str = TIME) -> DataFrame:
    return df.withColumns(calendar.calendar_parts(time))


def mean_by(
    df: DataFrame, part: str, value: str = TARGET_COLUMN, keys: Sequence[str] = SERIES, time: str = TIME
) -> DataFrame:
    """Mean load by ``hour``, ``day_of_week`` or ``month``."""
    grouped = df.withColumn(part, calendar.calendar_parts(time)[part]).groupBy(*keys, part)
    return grouped.agg(F.avg(value).alias("mean_load"))


def load_heatmap(
    df: DataFrame, value: str = TARGET_COLUMN, keys: Sequence[str] = SERIES, time: str = TIME
) -> DataFrame | None:
    """Mean load, one row per hour and one column per weekday.

    Uses ``hour`` / ``day_of_week`` columns when both are there, else the
    time axis; ``None`` when neither or no load is given. The seven columns
    are fixed, so nothing has to be read to plan the pivot.
    """
    if value not in df.columns:
        return None
    if not {"hour", "day_of_week"} <= set(df.columns):
        if time not in df.columns:
            return None
        parts = calendar.calendar_parts(time)
        df = df.withColumns({c: parts[c] for c in ("hour", "day_of_week")})
    wide = df.groupBy(*keys, "hour").pivot("day_of_week", list(range(7))).agg(F.avg(value))
    return wide.withColumnsRenamed({str(i): name for i, name in enumerate(DAY_NAMES)})


def iqr_bounds(df: DataFrame, value: str = TARGET_COLUMN, keys: Sequence[str] = SERIES) -> DataFrame:
    """q1, q3, iqr and the 1.5-iqr limits."""
    q = exact_quantiles(df, value, [0.25, 0.75], keys, names=["q1", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    return q.withColumns({
        "lower": F.col("q1") - F.lit(1.5) * F.col("iqr"),
        "upper": F.col("q3") + F.lit(1.5) * F.col("iqr"),
    })


def iqr_outliers(
    df: DataFrame, bounds: DataFrame, value: str = TARGET_COLUMN, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Rows outside ``bounds`` (from ``iqr_bounds``)."""
    limits = bounds.select(*keys, "lower", "upper")
    marked = attach(df, limits, keys)
    outside = (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    return marked.where(outside).drop("lower", "upper")
