"""From feature table to scaled sequences and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import WindowError
from ..functions.scaling import span
from ..schema import (
    DETECTOR_COLUMNS, FEATURE_COLUMNS, FILTER_SIGMAS, FORECAST_HORIZON, HOUR, SEQUENCE_LENGTH, SERIES,
    TARGET_COLUMN, TIME, TRAIN_RATIO, VAL_RATIO, WINDOW_LENGTH, WINDOW_STRIDE,
)
from . import axis, quality


def select_features(df: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS,
                    keep: Sequence[str] = (*SERIES, TIME)) -> DataFrame:
    """The model inputs as doubles, in their fixed order."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])


def split_limits(n: Column, train: float = TRAIN_RATIO, val: float = VAL_RATIO) -> tuple[Column, Column]:
    """Positions where validation and test begin."""
    total = n.cast("double")
    return F.floor(total * F.lit(train)), F.floor(total * F.lit(train + val))


def chrono_split(
    df: DataFrame, keys: Sequence[str] = SERIES, time: str = TIME, step: int = HOUR,
    train: float = TRAIN_RATIO, val: float = VAL_RATIO, gapless: bool = False,
) -> DataFrame:
    """Label rows train / val / test by position, never at random.

    Adds ``pos``, ``n``, ``split``, ``split_pos`` and ``split_n``: the
    position inside the split and the rows of the split. ``gapless`` says that
    no step of a series is absent (it is checked): positions then need no
    numbering, and large tables no shuffle.
    """
    placed = (axis.gapless_position if gapless else axis.with_position)(df, keys, time, step)
    first, second = split_limits(F.col("n"), train, val)
    placed = placed.withColumns({"_a": first, "_b": second})

    def pick(x: str, y: str, z: str):
        return F.expr(f"CASE WHEN pos < _a THEN {x} WHEN pos < _b THEN {y} ELSE {z} END")

    return placed.withColumns({
        "split": pick("'train'", "'val'", "'test'"),
        "split_pos": pick("pos", "pos - _a", "pos - _b"),
        "split_n": pick("_a", "_b - _a", "n - _b"),
    }).drop("_a", "_b")


def split_usable(
    df: DataFrame, keys: Sequence[str] = SERIES, time: str = TIME, step: int = HOUR, min_rows: int = 0, **options,
) -> tuple[DataFrame, DataFrame]:
    """(split rows, table of rows and series that are left out); see ``quality.set_aside``."""
    usable, rejects = quality.set_aside(df, keys, time, min_rows)
    return chrono_split(usable, keys, time, step, **options), rejects


def normal_rows(df: DataFrame, sigmas: float = FILTER_SIGMAS, value: str = TARGET_COLUMN) -> DataFrame:
    """Rows within ``sigmas`` deviations of their 24-hour rolling mean."""
    distance = F.abs(F.col(value) - F.col("rolling_mean_24"))
    return df.where(distance <= F.lit(sigmas) * F.col("rolling_std_24"))


# --- min-max scaling --------------------------------------------------------

def fit_minmax(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """``min_<c>`` and ``max_<c>`` per series; give it the training rows only."""
    bounds = [F.expr(f"{side}(cast(`{c}` AS DOUBLE)) AS `{side}_{c}`") for c in columns for side in ("min", "max")]
    return df.groupBy(*keys).agg(*bounds) if keys else df.agg(*bounds)


def _rescaled(df, params, columns, keys, factor, formula):
    """The range is turned into one factor per series and column before the
    join: what is left per row is short enough for the JIT compiler."""
    small = params.selectExpr(*keys, *[f"`min_{c}` AS `_low_{c}`" for c in columns],
                              *[f"{factor.format(span(f'`min_{c}`', f'`max_{c}`'))} AS `_by_{c}`" for c in columns])
    wide = axis.attach(df, small, keys)
    made = {c: formula.format(value=f"cast(`{c}` AS DOUBLE)", low=f"`_low_{c}`", by=f"`_by_{c}`") + f" AS `{c}`"
            for c in columns}
    return wide.selectExpr(*[made.get(c, f"`{c}`") for c in df.columns])


def transform_minmax(df: DataFrame, params: DataFrame, columns: Sequence[str],
                     keys: Sequence[str] = SERIES) -> DataFrame:
    return _rescaled(df, params, columns, keys, "1D / ({})", "({value} - {low}) * {by}")


def inverse_minmax(df: DataFrame, params: DataFrame, columns: Sequence[str],
                   keys: Sequence[str] = SERIES) -> DataFrame:
    return _rescaled(df, params, columns, keys, "{}", "{value} * {by} + {low}")


# --- sequences and windows --------------------------------------------------

def sequences(
    df: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS, target: str = TARGET_COLUMN,
    keys: Sequence[str] = SERIES, time: str = TIME, pos: str = "pos",
    length: int = SEQUENCE_LENGTH, horizon: int = FORECAST_HORIZON, chunk_rows: int = axis.CHUNK_ROWS,
) -> DataFrame:
    """One row per origin: ``x`` (length x features), ``y`` (horizon values).

    ``df`` carries the dense position ``pos``; add a split column to ``keys``
    (with its position) to keep sequences inside their split. The origin is
    the last input row. For training prefer ``forecast.training_frame``,
    which does not copy every row ``length`` times.
    """
    chunked = axis.with_chunks(
        df.select(*keys, time, pos, F.array(*[F.col(c).cast("double") for c in columns]).alias("_row"),
                  F.col(target).cast("double").alias("_y")),
        F.col(pos), back=length - 1, ahead=horizon, chunk_rows=chunk_rows,
    )
    w = axis.chunk_window(keys)
    past = w.rowsBetween(-(length - 1), 0)
    cut_out = chunked.withColumns({
        "first_ts": F.first(time).over(past),
        "x": F.collect_list("_row").over(past),
        "y": F.collect_list("_y").over(w.rowsBetween(1, horizon)),
    })
    whole = axis.drop_chunks(cut_out).where((F.size("x") == length) & (F.size("y") == horizon))
    return whole.select(*keys, F.col(pos).alias("origin_pos"), "first_ts",
                        F.col(time).alias("origin_ts"), "x", "y")


def require_rows(df: DataFrame, length: int, keys: Sequence[str] = SERIES) -> None:
    """Raise when no series is long enough for a window of ``length``."""
    longest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()[0] or 0
    if longest < length:
        raise WindowError(f"not enough rows to form a window (need at least {length}, got {longest})")


def require_sequences(split_rows: DataFrame, length: int = SEQUENCE_LENGTH, horizon: int = FORECAST_HORIZON) -> None:
    """Raise when a split has no series long enough for one sequence."""
    longest = {r["split"]: r["n"] for r in split_rows.groupBy("split").agg(F.max("split_n").alias("n")).collect()}
    for split in ("train", "val", "test"):
        if longest.get(split, 0) < length + horizon:
            raise WindowError(f"{split} data too short: {longest.get(split, 0)} rows, need {length + horizon}")


def window_cells(
    df: DataFrame, length: int = WINDOW_LENGTH, stride: int = WINDOW_STRIDE, pos: str = "pos", n: str = "n",
) -> DataFrame:
    """Rows of every whole window in long form: adds ``window_id`` and ``offset``.

    Window ``k`` covers the positions ``k*stride .. k*stride+length-1``. A row
    is repeated once per window that covers it, so not at all when the stride
    is at least the length. Rows of the dropped tail give nothing.
    """
    last = f"floor((`{n}` - {length}) / {stride})"
    if stride >= length:
        window_id, offset = f"floor(`{pos}` / {stride})", f"cast(`{pos}` % {stride} AS INT)"
        return df.where(f"`{pos}` % {stride} < {length} AND {window_id} <= {last}").withColumns(
            {"window_id": F.expr(window_id), "offset": F.expr(offset)})
    newest = f"least(floor(`{pos}` / {stride}), {last})"
    oldest = f"greatest(0L, ceil((`{pos}` - {length - 1}) / {stride}))"
    covered = df.withColumns({"_lo": F.expr(oldest), "_hi": F.expr(newest)}).where("_lo <= _hi")
    out = covered.withColumn("window_id", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    return out.withColumn("offset", F.expr(f"cast(`{pos}` - window_id * {stride} AS INT)"))


def windows(
    df: DataFrame, columns: Sequence[str] = DETECTOR_COLUMNS, keys: Sequence[str] = SERIES, time: str = TIME,
    pos: str = "pos", n: str = "n", length: int = WINDOW_LENGTH, stride: int = WINDOW_STRIDE,
    chunk_rows: int = axis.CHUNK_ROWS,
) -> DataFrame:
    """One row per window: id, start and end time, ``cells`` (flat, by time).

    Overlapping windows are gathered inside overlapping chunks, so that a row
    is shuffled about once and not once per window.
    """
    row = F.array(*[F.col(c).cast("double") for c in columns]).alias("_row")
    narrow = df.select(*keys, F.col(time).alias("_ts"), pos, n, row)
    if stride >= length:
        grouped = window_cells(narrow, length, stride, pos, n).groupBy(*keys, "window_id").agg(
            F.min("_ts").alias("start_ts"), F.max("_ts").alias("end_ts"),
            F.sort_array(F.collect_list(F.struct("offset", "_row"))).alias("_rows"),
        )
        return grouped.withColumn("cells", F.flatten("_rows._row")).drop("_rows")
    chunked = axis.with_chunks(narrow, F.col(pos), back=length - 1, chunk_rows=chunk_rows)
    past = axis.chunk_window(keys).rowsBetween(-(length - 1), Window.currentRow)
    gathered = axis.drop_chunks(chunked.withColumns({
        "start_ts": F.first("_ts").over(past), "_rows": F.collect_list("_row").over(past),
    }))
    start = F.col(pos) - F.lit(length - 1)
    return gathered.where((start >= 0) & (start % F.lit(stride) == 0)).select(
        *keys, F.floor(start / F.lit(stride)).alias("window_id"), "start_ts",
        F.col("_ts").alias("end_ts"), F.flatten("_rows").alias("cells"),
    )
