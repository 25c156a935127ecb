"""Lag, rolling and calendar features of a load series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..schema import HOUR, SERIES, TARGET_COLUMN, TIME
from . import axis

DAY_ROWS = 24
WEEK_ROWS = 168


def _in_chunks(
    df: DataFrame, keys: Sequence[str], time: str, step: int, gapless: bool, back: int, chunk_rows: int,
) -> DataFrame:
    """Chunks for row-counting windows.

    On a gap-free axis the time itself is the position. Otherwise rows have
    to be numbered first, because a lag counts rows and not hours.
    """
    if gapless:
        return axis.with_chunks(df, axis.tick(time, step), back=back, chunk_rows=chunk_rows)
    numbered = axis.with_position(df, keys, time, step)
    return axis.with_chunks(numbered, F.col("pos"), back=back, chunk_rows=chunk_rows).drop("pos", "n")


def lags(
    df: DataFrame, offsets: Sequence[int] = (1, DAY_ROWS, WEEK_ROWS), value: str = TARGET_COLUMN,
    keys: Sequence[str] = SERIES, time: str = TIME, step: int = HOUR,
    gapless: bool = False, chunk_rows: int = axis.CHUNK_ROWS,
) -> DataFrame:
    """``lag_k``: the value k rows earlier, null where there is none."""
    chunked = _in_chunks(df, keys, time, step, gapless, max(offsets), chunk_rows)
    w = axis.chunk_window(keys)
    return axis.drop_chunks(chunked.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in offsets}))


def _frame(w, rows: int):
    return w.rowsBetween(-(rows - 1), Window.currentRow)


def _rolling(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """24-row and 168-row statistics in one sort.

    The 168-row sum is the sum of seven 24-row sums a day apart, so a row
    reads 24 + 7 values and not 24 + 168.
    """
    short = _frame(axis.chunk_window(keys), DAY_ROWS)
    spec = axis.chunk_window_sql(keys)
    df = df.withColumns({
        "_sum": F.sum(value).over(short),
        "_cnt": F.count(value).over(short),
        "_std": F.stddev_samp(value).over(short),
    })
    df = df.withColumns({
        name: F.expr(" + ".join([column, *[f"lag({column}, {back}) OVER ({spec})"
                                           for back in range(DAY_ROWS, WEEK_ROWS, DAY_ROWS)]]))
        for name, column in (("_sum_week", "_sum"), ("_cnt_week", "_cnt"))
    })
    return df.withColumns({
        "rolling_mean_24": F.expr(f"if(_cnt = {DAY_ROWS}, _sum / {DAY_ROWS}, null)"),
        "rolling_std_24": F.expr(f"if(_cnt = {DAY_ROWS}, _std, null)"),
        "rolling_mean_168": F.expr(f"if(_cnt_week = {WEEK_ROWS}, _sum_week / {WEEK_ROWS}, null)"),
    }).drop("_sum", "_cnt", "_std", "_sum_week", "_cnt_week")


def rolling_stats(
    df: DataFrame, value: str = TARGET_COLUMN, keys: Sequence[str] = SERIES, time: str = TIME,
    step: int = HOUR, gapless: bool = False, chunk_rows: int = axis.CHUNK_ROWS,
) -> DataFrame:
    """Trailing mean 24 / 168 and sample deviation 24.

    The current row is included and the result is null until the window is
    full, also when a value inside it is missing.
    """
    chunked = _in_chunks(df, keys, time, step, gapless, WEEK_ROWS - 1, chunk_rows)
    return axis.drop_chunks(_rolling(chunked, value, keys))


def trailing_stats(
    df: DataFrame, rows: int = DAY_ROWS, value: str = TARGET_COLUMN, keys: Sequence[str] = SERIES,
    time: str = TIME, step: int = HOUR, gapless: bool = False, chunk_rows: int = axis.CHUNK_ROWS,
) -> DataFrame:
    """Mean and population deviation over up to ``rows`` rows.

    The variant used on a series that is being extended: the window shrinks
    at the start, and one value alone has deviation 0.
    """
    chunked = _in_chunks(df, keys, time, step, gapless, rows - 1, chunk_rows)
    frame = _frame(axis.chunk_window(keys), rows)
    return axis.drop_chunks(chunked.withColumns({
        f"trailing_mean_{rows}": F.avg(value).over(frame),
        f"trailing_std_{rows}": F.stddev_pop(value).over(frame),
    }))


def calendar_features(df: DataFrame, holidays: DataFrame | None, time: str = TIME) -> DataFrame:
    """Parts, weekend and holiday flags, cyclic encodings (no shuffle)."""
    parts = calendar.calendar_parts(time)
    df = df.withColumns({
        "hour": parts["hour"], "day_of_week": parts["day_of_week"], "month": parts["month"],
        "is_weekend": calendar.weekend_flag(time), **calendar.cyclic_encoding(time),
    })
    if holidays is None:
        return df.withColumn("is_holiday", F.lit(0))
    return calendar.holiday_flag(df, holidays, time)


def load_features(
    df: DataFrame, holidays: DataFrame | None = None, value: str = TARGET_COLUMN,
    keys: Sequence[str] = SERIES, time: str = TIME, step: int = HOUR,
    gapless: bool = False, drop_incomplete: bool = True, chunk_rows: int = axis.CHUNK_ROWS,
    chunked: bool = False, parts: int = 0,
) -> DataFrame:
    """The feature table: raw columns, calendar, three lags, three rolling.

    Lags and rolling values share one shuffle and one sort; the calendar
    columns are added after it so that they are not shuffled. Rows with any
    missing value are dropped, which removes at least the first 168 rows.
    ``chunked`` says that ``df`` is in chunks with the 168 rows before them;
    with ``parts``, the number of tasks that chunks are dealt to, the number of
    the chunk is kept as ``axis.BLOCK``.
    """
    cut_up = df if chunked else _in_chunks(df, keys, time, step, gapless, WEEK_ROWS, chunk_rows)
    w = axis.chunk_window(keys)
    lagged = cut_up.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in (1, DAY_ROWS, WEEK_ROWS)})
    rolled = _rolling(lagged, value, keys)
    wide = axis.drop_chunks(axis.keep_block(rolled, parts) if parts else rolled)
    out = calendar_features(wide, holidays, time)
    return out.dropna("any") if drop_incomplete else out


def load_features_from(
    df: DataFrame, start, holidays: DataFrame | None = None, time: str = TIME, step: int = HOUR, **options,
) -> DataFrame:
    """Feature rows from ``start`` on, reading only the history they need.

    A time filter cannot be pushed below a window, so the scan is filtered by
    hand at ``start`` minus 168 steps. Needs a gap-free axis.
    """
    since = axis.shift_time(F.lit(start).cast("timestamp"), F.lit(-WEEK_ROWS), step)
    recent = df.where(F.col(time) >= since)
    made = load_features(recent, holidays, time=time, step=step, gapless=True, **options)
    return made.where(F.col(time) >= F.lit(start).cast("timestamp"))
