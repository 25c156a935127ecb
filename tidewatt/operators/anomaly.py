"""Unusual 24-hour windows by reconstruction error.

Two detectors share everything but the reconstruction: the mean profile (each
cell of a window is rebuilt as its training mean) and a linear autoencoder
(PCA to 32 components and back). Any other model can score windows through
``score_windows``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WindowError
from ..functions.scaling import span
from ..functions.severity import is_above, severity_by_excess, severity_by_sigma
from ..schema import (
    BOTTLENECK, DETECTOR_COLUMNS, HOUR, MAX_ERROR_BUFFER, SERIES, SEVERITY_LEVELS, TIME, WINDOW_LENGTH,
    WINDOW_STRIDE,
)
from ..session import cut, stage, staged
from . import axis, prepare
from .quantiles import exact_quantiles


# --- mean profile -----------------------------------------------------------

def fit_profile(
    scaled: DataFrame, columns: Sequence[str] = DETECTOR_COLUMNS, keys: Sequence[str] = SERIES,
    length: int = WINDOW_LENGTH, stride: int = WINDOW_STRIDE,
) -> DataFrame:
    """The mean of every (offset, feature) cell over the training windows.

    One row per series and offset, ``profile_<feature>`` columns.
    """
    cells = prepare.window_cells(scaled, length, stride)
    return cells.groupBy(*keys, "offset").agg(*[F.expr(f"avg(`{c}`) AS `profile_{c}`") for c in columns])


def profile_errors(
    scaled: DataFrame, profile: DataFrame, columns: Sequence[str] = DETECTOR_COLUMNS,
    keys: Sequence[str] = SERIES, time: str = TIME, length: int = WINDOW_LENGTH, stride: int = WINDOW_STRIDE,
    model_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Mean absolute error of each window against the profile.

    A row is reduced to one number before the windows are grouped, so only
    (window, partial sum) pairs are shuffled. A window with a null in any of
    its cells, or without a profile, has no error (null). ``model_keys`` are the keys the
    profile was fitted by, all of ``keys`` unless given.
    """
    model_keys = list(keys if model_keys is None else model_keys)
    cells = prepare.window_cells(scaled.select(*keys, time, "pos", "n", *columns), length, stride)
    wide = axis.attach(cells, profile, [*model_keys, "offset"])
    gap = F.expr(" + ".join(f"abs(`{c}` - `profile_{c}`)" for c in columns))
    return wide.groupBy(*keys, "window_id").agg(
        F.min(time).alias("start_ts"), F.max(time).alias("end_ts"),
        F.when(F.count(gap) == length, F.sum(gap) / F.lit(length * len(columns))).alias("error"))


def window_parameters(scaler: DataFrame, profile: DataFrame, threshold: DataFrame | None = None,
                      keys: Sequence[str] = SERIES, columns: Sequence[str] = DETECTOR_COLUMNS) -> DataFrame:
    """Everything that scoring a window needs, as one row for each series.

    ``_low`` and ``_by`` scale the columns, ``_profile`` has the cells by
    offset and column, ``threshold`` and ``_std`` flag the error.
    """
    keys = list(keys)
    cells = F.array(*[F.col(f"profile_{c}") for c in columns])
    flat = profile.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("offset", cells.alias("cells")))).alias("_rows"))
    flat = flat.select(*keys, F.flatten("_rows.cells").alias("_profile"))
    span_of = lambda c: span(f"`min_{c}`", f"`max_{c}`")
    scales = scaler.select(*keys, F.array(*[F.col(f"min_{c}") for c in columns]).alias("_low"),
                           F.array(*[F.expr(f"1D / ({span_of(c)})") for c in columns]).alias("_by"))
    made = scales.join(flat, keys)
    return stage(made if threshold is None else _with_limits(made, threshold, keys), "parameters")


def _with_limits(params: DataFrame, threshold: DataFrame, keys: list[str]) -> DataFrame:
    return params.join(threshold.select(*keys, "threshold", F.col("std").alias("_std")), keys, "left")


def errors_by_parameters(
    rows: DataFrame, params: DataFrame, columns: Sequence[str] = DETECTOR_COLUMNS, keys: Sequence[str] = SERIES,
    time: str = TIME, length: int = WINDOW_LENGTH, stride: int = WINDOW_STRIDE,
) -> DataFrame:
    """``profile_errors`` of unscaled rows with one join: scaling and profile come with ``window_parameters``.

    A threshold among the parameters is handed on with the windows.
    """
    keys = list(keys)
    cells = prepare.window_cells(rows.select(*keys, time, "pos", "n", *columns, *axis.block_of(rows)), length, stride)
    wide = axis.attach(cells, params, keys, values=len(columns) * (length + 2) + 2)
    width = len(columns)
    gap = F.expr(" + ".join(
        f"abs((cast(`{c}` AS DOUBLE) - _low[{i}]) * _by[{i}] - _profile[`offset` * {width} + {i}])" for i, c in enumerate(columns)))
    limits = [F.first(c).alias(c) for c in ("threshold", "_std") if c in params.columns]
    return wide.groupBy(*keys, "window_id").agg(
        F.min(time).alias("start_ts"), F.max(time).alias("end_ts"),
        F.when(F.count(gap) == length, F.sum(gap) / F.lit(length * width)).alias("error"), *limits)


def mean_profile_model(profile: np.ndarray) -> Callable:
    """A predict function for ``score_windows`` that returns a fixed profile."""
    def make():
        def predict(inputs: np.ndarray) -> np.ndarray:
            return np.broadcast_to(profile, inputs.shape).reshape(len(inputs), -1)
        return predict
    return make


# --- linear autoencoder -----------------------------------------------------

@dataclass
class LinearAutoencoder:
    mean: np.ndarray        # (cells,)
    components: np.ndarray  # (cells, k), orthonormal columns
    # of the fit, where it is known: windows, the components' variances and that of all cells
    n_windows: int | None = None
    variances: np.ndarray | None = None
    total_variance: float | None = None


def fit_autoencoder(windows: DataFrame, k: int = BOTTLENECK, cells: str = "cells") -> LinearAutoencoder:
    """Principal components of the flattened training windows.

    The covariance is added up across the cluster; only the model, whose size
    is set by the window shape, comes to the driver.
    """
    vectors = windows.select(array_to_vector(cells).alias("v"))
    stats = vectors.select(Summarizer.metrics("mean", "count").summary(F.col("v")).alias("s"))
    row = stats.select("s.mean", "s.count").first()
    if row is None or row["count"] <= k:
        raise WindowError(f"{row['count'] if row else 0} training windows cannot give {k} components; "
                          "use a smaller stride or fewer components")
    fitted = PCA(k=k, inputCol="v", outputCol="z").fit(vectors)
    return LinearAutoencoder(row["mean"].toArray(), fitted.pc.toArray())


def window_products(rows: np.ndarray, length: int, stride: int = 1) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and sum of products of the flattened windows of consecutive ``rows``; windows with a NaN are left out.

    With stride 1 the products of the cells at offsets i and i + lag are those
    at offsets i - 1 and i - 1 + lag, less the first pair of rows and with one
    more at the end. So a row is multiplied with each of the ``length`` rows
    after it once, and not in every window that has both.
    """
    n, width = len(rows) - length + 1, rows.shape[1]
    size = length * width
    if n <= 0:
        return 0, np.zeros(size), np.zeros((size, size))
    if stride != 1 or not np.isfinite(rows).all():
        cells = np.lib.stride_tricks.sliding_window_view(rows, length, axis=0).transpose(0, 2, 1)[::stride].reshape(-1, size)
        cells = cells[np.isfinite(cells).all(1)]
        return len(cells), cells.sum(0), cells.T @ cells
    total = np.concatenate([np.zeros((1, width)), np.cumsum(rows, 0)])
    sums = np.concatenate([total[i + n] - total[i] for i in range(length)])
    products = np.empty((length, width, length, width))
    for lag in range(length):
        block = rows[:n].T @ rows[lag:lag + n]
        for i in range(length - lag):
            if i:
                block = block - np.outer(rows[i - 1], rows[i - 1 + lag]) + np.outer(rows[i + n - 1], rows[i + n - 1 + lag])
            products[i, :, i + lag, :] = block
            products[i + lag, :, i, :] = block.T
    return n, sums, products.reshape(size, size)


def fit_autoencoder_rows(
    scaled: DataFrame, k: int = BOTTLENECK, columns: Sequence[str] = DETECTOR_COLUMNS, keys: Sequence[str] = SERIES,
    length: int = WINDOW_LENGTH, stride: int = 1, chunk_rows: int = axis.CHUNK_ROWS,
) -> LinearAutoencoder:
    """``fit_autoencoder`` from the rows themselves (with ``pos``): windows are never written out.

    A task adds up the products of its chunks; one row of a product matrix for
    each cell of a window is shuffled, and only their sums, whose size is set
    by the window shape, come to the driver.
    """
    width = len(columns)
    size = length * width

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(size), np.zeros((size, size))

        def take(rows: list[np.ndarray], first: int) -> None:
            nonlocal count, sums, products
            block = np.concatenate(rows)
            skipped = -first % stride  # windows start at multiples of the stride
            n, s, p = window_products(block[skipped:], length, stride)
            count, sums, products = count + n, sums + s, products + p

        held, key, first = [], None, 0
        for batch in batches:
            names = np.array(list(zip(*[batch.column(c).to_pylist() for c in [*keys, "_chunk"]], strict=True)) or [()], object)
            at = batch.column("_at").to_numpy()
            cells = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64)
            edges = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1 if batch.num_rows else []
            for low, high in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if low == high:
                    continue
                own = tuple(names[low])
                if held and own != key:
                    take(held, first)
                    held = []
                if not held:
                    key, first = own, int(at[low])
                held.append(cells[low:high])
        if held:
            take(held, first)
        if count:
            yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, count)), pa.array(sums),
                                   pa.array(list(products), pa.list_(pa.float64()))], names=["cell", "n", "total", "products"])

    narrow = scaled.select(*keys, "pos", *[F.col(c).cast("double").alias(c) for c in columns])
    # a chunk has the first rows of the next one: each window starts in exactly one
    chunked = axis.with_chunks(narrow, F.col("pos"), back=0, ahead=length - 1, chunk_rows=chunk_rows).drop("_own", "pos")
    rows = chunked.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "_at")
    parts = rows.mapInArrow(add, "cell int, n long, total double, products array<double>")
    added = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"),
                                      Summarizer.sum(array_to_vector("products")).alias("products")).orderBy("cell").collect()
    count = added[0]["n"] if added else 0
    if count <= k:
        raise WindowError(f"{count} training windows cannot give {k} components; use a smaller stride or fewer components")
    mean = np.array([r["total"] for r in added]) / count
    covariance = np.array([r["products"].toArray() for r in added]) / count - np.outer(mean, mean)
    variances, components = np.linalg.eigh(covariance)
    return LinearAutoencoder(mean, components[:, ::-1][:, :k].copy(), count, variances[::-1][:k].copy(), float(np.trace(covariance)))


def autoencoder_errors(windows: DataFrame, model: LinearAutoencoder, cells: str = "cells") -> DataFrame:
    """Adds ``error``: mean absolute difference to the reconstruction."""
    shared = windows.sparkSession.sparkContext.broadcast((model.mean, model.components))

    @F.pandas_udf("double")
    def error(batch: pd.Series) -> pd.Series:
        mean, components = shared.value
        x = np.stack(batch.to_numpy()) if len(batch) else np.empty((0, len(mean)))
        centred = x - mean
        rebuilt = centred @ components @ components.T
        return pd.Series(np.abs(centred - rebuilt).mean(axis=1))

    return windows.withColumn("error", error(cells)).drop(cells)


def score_windows(
    windows: DataFrame, make_predict: Callable, shape: tuple[int, int], batch_size: int = 256,
    cells: str = "cells", output: str = "prediction",
) -> DataFrame:
    """Run a model over windows in batches.

    ``make_predict`` builds, once per worker process, a function from an array
    of shape (batch, *shape) to one of shape (batch, outputs).
    """
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                                input_tensor_shapes=[list(shape)])
    return windows.withColumn(output, predict(cells))


def reconstruction_error(cells: str = "cells", rebuilt: str = "prediction") -> Column:
    """Mean absolute difference of two flat arrays."""
    gaps = F.zip_with(cells, rebuilt, lambda a, b: F.abs(a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size(cells)


# --- threshold, flags, summaries --------------------------------------------

def fit_threshold(errors: DataFrame, keys: Sequence[str] = SERIES, method: str = "p99",
                  buffer: float = MAX_ERROR_BUFFER) -> DataFrame:
    """threshold, mean, std (population), p95, p99, max and method.

    ``p99`` takes the 99th percentile of the training errors, ``max_buffer``
    the largest one times ``buffer``.
    """
    if method not in ("p99", "max_buffer"):
        raise ValueError(f"unknown threshold method {method!r}")
    spread = [F.avg("error").alias("mean"), F.stddev_pop("error").alias("std"), F.max("error").alias("max_error")]
    stats = errors.groupBy(*keys).agg(*spread) if keys else errors.agg(*spread)
    high = exact_quantiles(errors, "error", [0.95, 0.99], keys, names=["p95", "p99"])
    both = stats.join(high, list(keys)) if keys else stats.crossJoin(F.broadcast(high))
    limit = F.col("p99") if method == "p99" else F.col("max_error") * F.lit(buffer)
    return both.select(*keys, limit.alias("threshold"), "mean", "std", "p95", "p99", "max_error",
                       F.lit(method).alias("method"))


def flag_windows(
    errors: DataFrame, threshold: DataFrame, keys: Sequence[str] = SERIES, severity: str = "excess"
) -> DataFrame:
    """Adds threshold, ``is_anomaly`` and ``severity`` (normal included).

    Both are null for a window without an error or of a series without a
    threshold; ``anomaly_summary`` counts those as ``n_unscored``.
    """
    limits = threshold.select(*keys, "threshold", F.col("std").alias("_std"))
    return _flagged(axis.attach(errors, limits, keys), severity)


def _flagged(wide: DataFrame, severity: str) -> DataFrame:
    """Flag and level of windows with their error, threshold and ``_std``."""
    e, t = F.col("error"), F.col("threshold")
    level = severity_by_excess(e, t) if severity == "excess" else severity_by_sigma(e, t, F.col("_std"))
    return wide.withColumns({"is_anomaly": is_above(e, t), "severity": level}).drop("_std")


def flagged_detail(flagged: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Time and severity of the flagged windows, in order."""
    return flagged.where("is_anomaly").select(*keys, "end_ts", "severity").orderBy(*keys, "end_ts")


def anomaly_timeline(flagged: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Every window with its error and level."""
    return flagged.select(*keys, "window_id", "error", "severity")


def anomaly_summary(flagged: DataFrame, keys: Sequence[str] = SERIES, decimals: int | None = 2) -> DataFrame:
    """Windows, flagged and unscored windows, and the rate among the scored.

    ``decimals=None`` leaves the rate exact; it is null where no window was scored.
    """
    hits, scored, count = F.count_if("is_anomaly"), F.count("is_anomaly"), F.count(F.lit(1))
    rate = F.when(scored > 0, F.lit(100.0) * hits / scored)
    return flagged.groupBy(*keys).agg(
        count.alias("n_windows"), hits.alias("n_anomalies"), (count - scored).alias("n_unscored"),
        (rate if decimals is None else F.round(rate, decimals)).alias("anomaly_rate"),
        F.max("threshold").alias("threshold"))


def severity_counts(flagged: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Windows at each of the four levels, zeros included."""
    return flagged.groupBy(*keys).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_LEVELS])


def error_summary(errors: DataFrame, keys: Sequence[str] = SERIES, split: str = "split") -> DataFrame:
    """Mean, population deviation and maximum of the errors by split."""
    return errors.groupBy(*keys, split).agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("error").alias("mean_error"),
        F.stddev_pop("error").alias("std_error"), F.max("error").alias("max_error"))


# --- whole detectors --------------------------------------------------------

@dataclass
class Detector:
    """Scaler and threshold per series, and one of the two reconstructions."""

    scaler: DataFrame
    threshold: DataFrame
    keys: list[str]
    profile: DataFrame | None = None
    autoencoder: LinearAutoencoder | None = None
    length: int = WINDOW_LENGTH
    step: int = HOUR
    # ``window_parameters`` of scaler and profile, where they are still there from the fit
    parameters: DataFrame | None = None


def window_errors(rows: DataFrame, detector_parts, keys, stride: int = WINDOW_STRIDE,
                  length: int = WINDOW_LENGTH, time: str = TIME) -> DataFrame:
    """Errors of the windows of positioned, unscaled rows."""
    scaler, profile, autoencoder, model_keys = detector_parts
    scaled = prepare.transform_minmax(
        rows.select(*keys, time, "pos", "n", *DETECTOR_COLUMNS), scaler, DETECTOR_COLUMNS, model_keys)
    if autoencoder is None:
        return profile_errors(scaled, profile, keys=keys, time=time, length=length, stride=stride,
                              model_keys=model_keys)
    return autoencoder_errors(prepare.windows(scaled, keys=keys, time=time, length=length, stride=stride),
                              autoencoder)


def fit_detector(
    train: DataFrame, keys: Sequence[str] = SERIES, step: int = HOUR, reconstruction: str = "profile",
    k: int = BOTTLENECK, fit_stride: int | None = None, stride: int = WINDOW_STRIDE, method: str = "p99",
    filter_normal: bool = True, length: int = WINDOW_LENGTH,
) -> Detector:
    """Filter, scale, cut windows, fit the reconstruction and the threshold.

    ``train`` holds the training feature rows. The scaler, the profile and
    the threshold are fitted per series; the autoencoder is one for all.
    """
    keys = list(keys)
    rows = prepare.normal_rows(train) if filter_normal else train
    narrow = rows.select(*keys, TIME, *DETECTOR_COLUMNS, *axis.block_of(rows))
    # numbered once and written: the passes below only read it
    with staged(axis.with_position(narrow, keys, step=step), "train-rows", **axis.dealing(narrow, keys)) as rows:
        scaler = cut(prepare.fit_minmax(rows, DETECTOR_COLUMNS, keys))
        scaled = prepare.transform_minmax(rows, scaler, DETECTOR_COLUMNS, keys)
        profile = autoencoder = params = None
        if reconstruction == "profile":
            profile = stage(fit_profile(scaled, keys=keys, length=length, stride=fit_stride or stride), "profile")
        elif reconstruction == "pca":
            # more windows than components are needed: fit on overlapping ones
            autoencoder = fit_autoencoder_rows(scaled, k, keys=keys, length=length, stride=fit_stride or 1)
        else:
            raise ValueError(f"unknown reconstruction {reconstruction!r}")
        if autoencoder is None:
            params = window_parameters(scaler, profile, keys=keys)
            errors = errors_by_parameters(rows, params, keys=keys, length=length, stride=stride)
        else:
            errors = window_errors(rows, (scaler, profile, autoencoder, keys), keys, stride, length)
        with staged(errors.select(*keys, "error"), "train-errors") as errors:
            threshold = cut(fit_threshold(errors, keys, method))
    return Detector(scaler, threshold, keys, profile, autoencoder, length, step, params)


def detect(
    df: DataFrame, detector: Detector, stride: int = WINDOW_STRIDE, severity: str = "excess", time: str = TIME,
    positioned: bool = False,
) -> DataFrame:
    """Score every whole window of every series and flag the unusual ones.

    ``positioned`` says that ``df`` already has the dense ``pos`` and ``n``.
    """
    keys = detector.keys
    rows = df if positioned else axis.with_position(df.drop("pos", "n"), keys, time, detector.step)
    if detector.autoencoder is None:
        if detector.parameters is None:
            params = window_parameters(detector.scaler, detector.profile, detector.threshold, keys)
        else:
            params = stage(_with_limits(detector.parameters, detector.threshold, keys), "parameters")
        return _flagged(errors_by_parameters(rows, params, keys=keys, time=time, length=detector.length, stride=stride), severity)
    parts = (detector.scaler, detector.profile, detector.autoencoder, keys)
    errors = window_errors(rows, parts, keys, stride, detector.length, time)
    return flag_windows(errors, detector.threshold, keys, severity)
