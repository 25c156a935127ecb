"""Load forecasts: seasonal-naive and fitted, 24 steps and 168 steps.

The fitted forecaster is direct multi-step: one training row per (origin,
step), made of the 16 scaled features at the origin, the calendar of the
target hour and the load one, two and seven days before the target. That is
24 rows per origin instead of a 168 x 16 copy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..errors import InputError
from ..functions import calendar
from ..functions.scaling import scale, served_load, unscale
from ..schema import (
    BAND_MARGIN, EXTENDED_HORIZON, EXTENDED_MARGIN_FACTOR, FEATURE_COLUMNS, FORECAST_HORIZON, HOUR,
    MIN_ROWS_EXTENDED, MIN_ROWS_FORECAST, SEQUENCE_LENGTH, SERIES, TARGET_COLUMN, TIME,
)
from ..session import cut, stage
from . import axis, prepare, quality

REFERENCES = (24, 48, 168)
CYCLE_COLUMNS = [f"{part}_{wave}" for part in calendar.CYCLES for wave in ("sin", "cos")]
TARGET_CYCLES = [f"target_{c}" for c in CYCLE_COLUMNS]
REFERENCE_COLUMNS = [f"load_{k}_before" for k in REFERENCES]
MODEL_INPUTS = [*FEATURE_COLUMNS, *TARGET_CYCLES, *REFERENCE_COLUMNS]


@dataclass
class Forecaster:
    """A fitted pipeline and the per-series min/max it was scaled with."""

    model: PipelineModel
    scaler: DataFrame
    keys: list[str]
    step: int = HOUR


# --- shared pieces ----------------------------------------------------------

def future_axis(
    origins: DataFrame, horizon: int = FORECAST_HORIZON, origin: str = "origin_ts", step: int = HOUR
) -> DataFrame:
    """Steps 1..horizon after each origin, with their time ``ts``."""
    out = origins.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return out.withColumn("ts", axis.shift_time(origin, F.col("step"), step))


def forecast_band(df: DataFrame, margin: Column | float = BAND_MARGIN, value: str = "yhat") -> DataFrame:
    """``lower`` / ``upper`` at a distance of the mean error, never below 0."""
    margin = margin if isinstance(margin, Column) else F.lit(float(margin))
    return df.withColumns({
        "lower": F.greatest(F.lit(0.0), F.col(value) - margin), "upper": F.col(value) + margin,
    })


def measured_band(
    df: DataFrame, accuracy: DataFrame, keys: Sequence[str] = SERIES, factor: float = 1.0, value: str = "yhat",
    margin: float = BAND_MARGIN,
) -> DataFrame:
    """The band at a distance of each series' own measured ``mae``, times ``factor``; ``margin`` where it has none."""
    wide = axis.attach(df, accuracy.select(*keys, F.col("mae").alias("_mae")), keys)
    return forecast_band(wide, F.coalesce("_mae", F.lit(float(margin))) * F.lit(float(factor)), value).drop("_mae")


def extended_band(df: DataFrame, margin: float = BAND_MARGIN, value: str = "yhat") -> DataFrame:
    """The wider band of the 168-step forecast."""
    return forecast_band(df, margin * EXTENDED_MARGIN_FACTOR, value)


def day_boundaries(df: DataFrame, horizon: int = EXTENDED_HORIZON) -> DataFrame:
    """The last step of each forecast day but the last."""
    return df.where((F.col("step") % FORECAST_HORIZON == 0) & (F.col("step") < horizon))


def pair_forecasts(
    actual: DataFrame, predicted: DataFrame, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Actual and predicted values of the same (series, origin, step)."""
    return actual.join(predicted, [*keys, "origin_ts", "step"])


def append_rows(history: DataFrame, new: DataFrame, keep: int = SEQUENCE_LENGTH,
                keys: Sequence[str] = SERIES, time: str = TIME) -> DataFrame:
    """Add rows to a history and keep the newest ``keep`` of each series."""
    return axis.last_rows(history.unionByName(new, allowMissingColumns=True), keep, keys, time)


# --- seasonal naive ---------------------------------------------------------

def seasonal_naive(
    df: DataFrame, horizon: int = FORECAST_HORIZON, value: str = TARGET_COLUMN,
    keys: Sequence[str] = SERIES, time: str = TIME, step: int = HOUR,
) -> DataFrame:
    """Each target takes the load of 168 rows before.

    With a horizon of at most 168 this equals the chained 7 x 24 forecast,
    because no target then looks back at a forecast. Only the last 168 rows
    of a series are shuffled.
    """
    if horizon > SEQUENCE_LENGTH:
        raise ValueError(f"horizon must be at most {SEQUENCE_LENGTH}")
    recent = axis.last_rows(df.select(*keys, time, value), SEQUENCE_LENGTH, keys, time)
    per_series = Window.partitionBy(*keys)
    placed = recent.withColumns({
        "origin_ts": F.max(time).over(per_series),
        "step": F.row_number().over(per_series.orderBy(time)),
        "_rows": F.count(F.lit(1)).over(per_series),
    })
    return placed.where((F.col("_rows") == SEQUENCE_LENGTH) & (F.col("step") <= horizon)).select(
        *keys, "origin_ts", "step",
        axis.shift_time("origin_ts", F.col("step"), step).alias("ts"),
        served_load(F.col(value)).alias("yhat"),
    )


def seasonal_reference(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SERIES, time: str = TIME, step: int = HOUR,
) -> DataFrame:
    """Weather for the next 168 steps: the first 24 of the last 168 rows, daily."""
    recent = axis.last_rows(df.select(*keys, time, *columns), SEQUENCE_LENGTH, keys, time)
    per_series = Window.partitionBy(*keys)
    placed = recent.withColumns({
        "origin_ts": F.max(time).over(per_series), "_at": F.row_number().over(per_series.orderBy(time)),
    }).where(F.col("_at") <= FORECAST_HORIZON)
    days = placed.withColumn("_day", F.explode(F.sequence(F.lit(0), F.lit(EXTENDED_HORIZON // FORECAST_HORIZON - 1))))
    return (
        days.withColumn("step", F.col("_day") * F.lit(FORECAST_HORIZON) + F.col("_at"))
        .select(*keys, "origin_ts", "step",
                axis.shift_time("origin_ts", F.col("step"), step).alias("ts"), *columns)
    )


def naive_pairs(
    df: DataFrame, horizon: int = FORECAST_HORIZON, value: str = TARGET_COLUMN,
    keys: Sequence[str] = SERIES, time: str = TIME,
) -> tuple[DataFrame, DataFrame]:
    """(actual, seasonal-naive) in long form for every origin of ``df``, to be
    put together by ``pair_forecasts`` like any other two."""
    rows = naive_pair_rows(df, horizon, value, keys, time)
    return rows.drop("yhat"), rows.drop("y")


def naive_pair_rows(
    df: DataFrame, horizon: int = FORECAST_HORIZON, value: str = TARGET_COLUMN,
    keys: Sequence[str] = SERIES, time: str = TIME, chunk_rows: int = axis.CHUNK_ROWS,
) -> DataFrame:
    """Actual ``y`` and seasonal-naive ``yhat`` of every origin and step of ``df``, without a join.

    Needs ``split_pos`` / ``split_n`` (``prepare.chrono_split``): an origin
    counts when its 168 input rows and its targets lie in the same split.
    """
    part = [*keys, "split"]
    chunked = axis.with_chunks(
        df.select(*part, time, "split_pos", "split_n", F.col(value).cast("double").alias("_v")),
        F.col("split_pos"), back=SEQUENCE_LENGTH - 1, ahead=horizon, chunk_rows=chunk_rows,
    )
    w = axis.chunk_window(part)
    lagged = w.rowsBetween(-(SEQUENCE_LENGTH - 1), horizon - SEQUENCE_LENGTH)
    both = axis.drop_chunks(chunked.withColumns({
        "y": _with_nulls("_v", w.rowsBetween(1, horizon)),
        "yhat": _with_nulls("_v", lagged),
    })).where(_whole_origin(horizon)).withColumnRenamed(time, "origin_ts")
    long = both.select(*part, "origin_ts", F.posexplode(F.arrays_zip("y", "yhat")).alias("_p", "_t"))
    return long.select(*part, "origin_ts", (F.col("_p") + 1).alias("step"), "_t.y", "_t.yhat")


def _with_nulls(column: str, window: WindowSpec) -> Column:
    """The values of a window in order; a null keeps its place, so that steps stay aligned."""
    return F.transform(F.collect_list(F.struct(F.col(column).alias("v"))).over(window), lambda s: s["v"])


def _whole_origin(horizon: int) -> Column:
    return (F.col("split_pos") >= SEQUENCE_LENGTH - 1) & (F.col("split_pos") + horizon < F.col("split_n"))


# --- fitted forecaster ------------------------------------------------------

def fit_scaler(split_rows: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Min/max of the 16 inputs and of the load on the training rows."""
    train = split_rows.where(F.col("split") == "train")
    return cut(prepare.fit_minmax(train, [*FEATURE_COLUMNS, TARGET_COLUMN], keys))


def origin_frame(
    split_rows: DataFrame, scaler: DataFrame, keys: Sequence[str] = SERIES, time: str = TIME,
    horizon: int = FORECAST_HORIZON, origin_stride: int = 1, chunk_rows: int = axis.CHUNK_ROWS,
) -> DataFrame:
    """One row per origin: scaled inputs, ``label`` and the earlier loads as
    arrays of ``horizon`` values.

    Origins need 168 input rows and ``horizon`` targets inside their split, and
    no null among the loads that they use.
    ``origin_stride`` above 1 keeps every k-th origin only. All shuffling is
    done here; ``step_rows`` unfolds the arrays without any.
    """
    part = [*keys, "split"]
    columns = [*FEATURE_COLUMNS, TARGET_COLUMN]
    scaled = prepare.transform_minmax(
        split_rows.select(*part, time, "split_pos", "split_n", *columns), scaler, columns, keys)
    chunked = axis.with_chunks(scaled, F.col("split_pos"), back=SEQUENCE_LENGTH - 1, ahead=horizon,
                               chunk_rows=chunk_rows)
    w = axis.chunk_window(part)
    frames = {"label": F.collect_list(TARGET_COLUMN).over(w.rowsBetween(1, horizon))}
    for k, name in zip(REFERENCES, REFERENCE_COLUMNS):
        frames[name] = F.collect_list(TARGET_COLUMN).over(w.rowsBetween(1 - k, horizon - k))
    origins = axis.drop_chunks(chunked.withColumns(frames)).where(_whole_origin(horizon))
    for name in frames:  # a null load shortens the array; such an origin has no aligned label
        origins = origins.where(F.size(name) == horizon)
    if origin_stride > 1:
        origins = origins.where(F.col("split_pos") % origin_stride == 0)
    return origins.select(*part, F.col(time).alias("origin_ts"), *FEATURE_COLUMNS, *frames)


def step_rows(origins: DataFrame, step: int = HOUR) -> DataFrame:
    """(origin, step) rows of ``origin_frame``."""
    unfolded = ["label", *REFERENCE_COLUMNS]
    kept = [c for c in origins.columns if c not in unfolded]
    rows = origins.select(*kept, F.posexplode(F.arrays_zip(*unfolded)).alias("_p", "_t"))
    return _target_columns(rows.select(*kept, (F.col("_p") + 1).alias("step"), "_t.*"), step)


def training_frame(
    split_rows: DataFrame, scaler: DataFrame, keys: Sequence[str] = SERIES, time: str = TIME,
    step: int = HOUR, horizon: int = FORECAST_HORIZON, origin_stride: int = 1,
    chunk_rows: int = axis.CHUNK_ROWS,
) -> DataFrame:
    """(origin, step) rows with scaled inputs and scaled ``label``."""
    return step_rows(origin_frame(split_rows, scaler, keys, time, horizon, origin_stride, chunk_rows), step)


def _target_columns(df: DataFrame, step: int) -> DataFrame:
    df = df.withColumn("ts", axis.shift_time("origin_ts", F.col("step"), step))
    cycles = calendar.cyclic_encoding("ts")
    return df.withColumns({f"target_{c}": cycles[c] for c in CYCLE_COLUMNS})


def estimator(**params) -> LinearRegression:
    """The default regressor; Huber loss, as robust to outliers as intended."""
    settings = {"loss": "huber", "epsilon": 1.35, "maxIter": 50, "regParam": 1e-4, **params}
    if settings["loss"] != "huber":
        # least squares is solved in one pass over the rows
        settings.pop("epsilon", None)
        settings.setdefault("solver", "normal")
    return LinearRegression(featuresCol="inputs", labelCol="label", predictionCol="scaled_yhat", **settings)


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=MODEL_INPUTS, outputCol="inputs")


def fit_forecaster(
    split_rows: DataFrame, keys: Sequence[str] = SERIES, step: int = HOUR, regressor=None,
    origin_stride: int = 1, scaler: DataFrame | None = None,
) -> Forecaster:
    """Fit on the training split. ``regressor`` may be any Spark ML regressor
    reading ``inputs`` / ``label`` and writing ``scaled_yhat``.

    The origins are written once; the passes of the solver unfold them into
    steps, which takes a quarter of the space of the unfolded rows.
    """
    scaler = fit_scaler(split_rows, keys) if scaler is None else scaler
    train = split_rows.where(F.col("split") == "train")
    origins = stage(origin_frame(train, scaler, keys, origin_stride=origin_stride), "origins")
    model = Pipeline(stages=[assembler(), regressor or estimator()]).fit(step_rows(origins, step))
    return Forecaster(model, scaler, list(keys), step)


def _load_scaled(df: DataFrame, fitted: Forecaster, formula, source: str, name: str) -> DataFrame:
    low, high = f"min_{TARGET_COLUMN}", f"max_{TARGET_COLUMN}"
    wide = axis.attach(df, fitted.scaler.select(*fitted.keys, low, high), fitted.keys)
    return wide.withColumn(name, F.expr(formula(source, low, high))).drop(low, high)


def predict_split(split_rows: DataFrame, fitted: Forecaster) -> DataFrame:
    """Predictions and actual loads for every origin of ``split_rows``."""
    rows = training_frame(split_rows, fitted.scaler, fitted.keys, step=fitted.step)
    scored = fitted.model.transform(rows).select(
        *fitted.keys, "split", "origin_ts", "step", "ts", "label", "scaled_yhat")
    scored = _load_scaled(scored, fitted, unscale, "label", "y")
    return _load_scaled(scored, fitted, unscale, "scaled_yhat", "yhat").drop("label", "scaled_yhat")


def _states(df: DataFrame, keys: Sequence[str], time: str, has_time: bool, need_load: bool) -> DataFrame:
    """One row per series: the newest features, 168 loads, 24 reference rows.

    All arrays have a fixed length, so this table grows with the number of
    series only.
    """
    columns = [F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS]
    if TARGET_COLUMN in df.columns:
        load = F.col(TARGET_COLUMN).cast("double").alias(TARGET_COLUMN)
    elif need_load:
        raise InputError(f"missing required columns: ['{TARGET_COLUMN}']")
    else:
        # without a load column the history is taken as zeros
        load = F.lit(0.0).alias(TARGET_COLUMN)
    recent = axis.last_rows(df.select(*keys, time, load, *columns), SEQUENCE_LENGTH, keys, time)
    rows = F.sort_array(F.collect_list(F.struct(time, TARGET_COLUMN, *FEATURE_COLUMNS)))
    grouped = recent.groupBy(*keys).agg(rows.alias("_rows")).where(F.size("_rows") == SEQUENCE_LENGTH)
    newest = F.element_at("_rows", -1)
    origin = newest[time] if has_time else F.lit(None).cast("timestamp")
    return grouped.select(
        *keys, origin.alias("origin_ts"), F.col(f"_rows.{TARGET_COLUMN}").alias("loads"),
        *[newest[c].alias(c) for c in FEATURE_COLUMNS],
        F.slice("_rows", 1, FORECAST_HORIZON).alias("_ref"),
    )


def _predict_day(states: DataFrame, fitted: Forecaster, has_time: bool) -> DataFrame:
    """The next 24 loads of every state, unscaled, rounded and not negative."""
    keys = fitted.keys
    wide = axis.attach(states, fitted.scaler, keys)
    low, high = f"min_{TARGET_COLUMN}", f"max_{TARGET_COLUMN}"
    inputs = {c: F.expr(scale(c, f"min_{c}", f"max_{c}")) for c in FEATURE_COLUMNS}
    inputs |= {
        name: F.expr(scale(f"element_at(loads, {SEQUENCE_LENGTH - k} + step)", low, high))
        for k, name in zip(REFERENCES, REFERENCE_COLUMNS)
    }
    steps = wide.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(FORECAST_HORIZON))))
    rows = _target_columns(steps.withColumns(inputs), fitted.step)
    if not has_time:
        # the hour of a target is not known: take it from the reference rows
        reference = F.element_at("_ref", F.col("step"))
        rows = rows.withColumns({f"target_{c}": reference[c] for c in CYCLE_COLUMNS})
    yhat = served_load(F.expr(unscale("scaled_yhat", low, high)))
    return fitted.model.transform(rows).select(*keys, "origin_ts", "step", "ts", yhat.alias("yhat"))


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("label", calendar.step_label("step", "ts"))


def run_forecast(
    df: DataFrame, fitted: Forecaster, time: str = TIME, has_time: bool = True, strict: bool = True
) -> DataFrame:
    """24 steps after the newest row of every series.

    Without a time axis (``has_time=False``) ``time`` names any column that
    orders the rows, and steps are labelled ``T+1h`` ...
    """
    if strict:
        quality.validate(df, FEATURE_COLUMNS, MIN_ROWS_FORECAST, fitted.keys)
    return _labelled(_predict_day(_states(df, fitted.keys, time, has_time, True), fitted, has_time))


def forecast_all(
    df: DataFrame, fitted: Forecaster, time: str = TIME, extended: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(forecasts, table of what has none): series that are too short and rows without a key or a time are reported.

    Unlike ``run_forecast`` one bad series does not stop the others.
    """
    quality.require_columns(df, FEATURE_COLUMNS)
    least = MIN_ROWS_EXTENDED if extended else MIN_ROWS_FORECAST
    usable, rejects = quality.set_aside(df, fitted.keys, time, least)
    run = run_extended_forecast if extended else run_forecast
    return run(usable, fitted, time, strict=False), rejects


def run_extended_forecast(
    df: DataFrame, fitted: Forecaster, time: str = TIME, has_time: bool = True, strict: bool = True
) -> DataFrame:
    """168 steps as seven chained days.

    Each day is forecast from the state left by the day before: the served
    (rounded) loads are appended, lags and rolling values are recomputed with
    population deviation, the calendar comes from the new times, holidays are
    0 and weather repeats the reference rows. Every day is one step over all
    series; its output and the state after it are checkpointed, so the plan
    does not grow.
    """
    if strict:
        quality.validate(df, FEATURE_COLUMNS, MIN_ROWS_EXTENDED, fitted.keys)
    keys = fitted.keys
    states = cut(_states(df, keys, time, has_time, False))
    first = states.select(*keys, F.col("origin_ts").alias("_first"))
    days = []
    for day in range(EXTENDED_HORIZON // FORECAST_HORIZON):
        if day:
            states = cut(_next_state(states, made, keys, has_time))
        made = cut(_predict_day(states, fitted, has_time))
        days.append(made.withColumn("step", F.col("step") + F.lit(day * FORECAST_HORIZON)))
    chained = days[0]
    for made in days[1:]:
        chained = chained.unionByName(made)
    # every day carries its own origin; report the first one
    out = chained.join(first, keys).select(*keys, F.col("_first").alias("origin_ts"), "step", "ts", "yhat")
    return _labelled(out)


def _mean(values: str, rows: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.lit(float(rows))


def _next_state(states: DataFrame, made: DataFrame, keys: list[str], has_time: bool) -> DataFrame:
    day = made.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("step", "yhat"))).getField("yhat").alias("_new"),
        F.max("ts").alias("_ts"),
    )
    last = SEQUENCE_LENGTH + FORECAST_HORIZON
    joined = states.join(day, keys).withColumn("_all", F.concat("loads", "_new"))
    joined = joined.withColumns({
        "_day": F.slice("_all", last - 23, 24), "_week": F.slice("_all", last - 167, 168),
    }).withColumn("_day_mean", _mean("_day", 24))
    squares = F.aggregate("_day", F.lit(0.0),
                          lambda total, v: total + (v - F.col("_day_mean")) * (v - F.col("_day_mean")))
    reference = F.element_at("_ref", FORECAST_HORIZON)
    values = {c: reference[c] for c in FEATURE_COLUMNS}
    if has_time:
        values |= {"is_weekend": calendar.weekend_flag("_ts").cast("double"), "is_holiday": F.lit(0.0),
                   **calendar.cyclic_encoding("_ts")}
    values |= {
        "lag_1": F.element_at("_all", last - 1), "lag_24": F.element_at("_all", last - 24),
        "lag_168": F.element_at("_all", last - 168),
        "rolling_mean_24": F.col("_day_mean"), "rolling_std_24": F.sqrt(squares / F.lit(24.0)),
        "rolling_mean_168": _mean("_week", 168),
    }
    return joined.select(
        *keys, F.col("_ts").alias("origin_ts"), F.col("_week").alias("loads"),
        *[values[c].alias(c) for c in FEATURE_COLUMNS], "_ref",
    )
