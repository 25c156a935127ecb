"""Train-and-evaluate jobs: hyper-parameter search, forecaster, detector."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import asdict
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scaling import unscale
from ..operators import anomaly, axis, forecast, prepare, quality, report, rounds
from ..schema import DETECTOR_COLUMNS, FEATURE_COLUMNS, HOUR, SERIES, TARGET_COLUMN, TIME, TRIALS
from ..session import cut, owned_scratch, stage
from ..sources import artefacts

TRIALS_SCHEMA = ("trial int, learning_rate double, momentum double, l2 double, warmup int, rounds int, patience int, "
                 "best_round int, val_loss double, val_mae double")

# Trials of a search that are fitted at the same time.
PARALLEL_FITS = 4
# The values a search trial draws from.
SEARCH_SPACE = {
    "loss": ["huber", "squaredError"],
    "epsilon": [1.1, 1.35, 2.0, 5.0],
    "regParam": [0.0, 1e-4, 1e-3, 1e-2, 1e-1],
    "elasticNetParam": [0.0],
    "maxIter": [25, 50],
    "standardization": [True, False],
}


def search_points(trials: int = TRIALS, seed: int = 42) -> list[dict]:
    """Distinct random draws from the search space, the same for a seed."""
    others = math.prod(len(v) for k, v in SEARCH_SPACE.items() if k not in ("loss", "epsilon"))
    distinct = others * sum(len(SEARCH_SPACE["epsilon"]) if loss == "huber" else 1 for loss in SEARCH_SPACE["loss"])
    if trials > distinct:
        raise ValueError(f"{trials} trials asked for, but the search space has {distinct} points")
    draw, points = random.Random(seed), []
    while len(points) < trials:
        point = {k: draw.choice(v) for k, v in SEARCH_SPACE.items()}
        if point["loss"] != "huber":
            point.pop("epsilon")
        if point not in points:
            points.append(point)
    return points


def tune_forecaster(
    split_rows: DataFrame, keys: Sequence[str] = SERIES, step: int = HOUR, trials: int = TRIALS,
    seed: int = 42, origin_stride: int = 1, scaler: DataFrame | None = None,
) -> DataFrame:
    """(trial, params, val_mae) of every trial, best first.

    Trials are fitted on the training split and scored on the later
    validation split. The training origins are written once and all trials
    are scored in one pass over the validation rows.
    """
    spark = split_rows.sparkSession
    scaler = forecast.fit_scaler(split_rows, keys) if scaler is None else scaler
    assembler = forecast.assembler()

    def rows(split: str) -> DataFrame:
        part = split_rows.where(F.col("split") == split)
        origins = forecast.origin_frame(part, scaler, keys, origin_stride=origin_stride)
        if split == "train":
            origins = stage(origins, "origins")
        return assembler.transform(forecast.step_rows(origins, step)).select(*keys, "inputs", "label")

    train = rows("train")
    points = search_points(trials, seed)
    with ThreadPool(PARALLEL_FITS) as pool:
        models = pool.map(inheritable_thread_target(spark)(lambda p: forecast.estimator(**p).fit(train)), points)

    low, high = f"min_{TARGET_COLUMN}", f"max_{TARGET_COLUMN}"
    val = axis.attach(rows("val"), scaler.select(*keys, low, high), keys)
    val = val.withColumn("_x", vector_to_array("inputs"))
    val = val.withColumn("_y", F.expr(unscale("label", low, high)))
    errors = []
    for i, model in enumerate(models):
        weights = [f"{w!r}D * _x[{j}]" for j, w in enumerate(model.coefficients.toArray().tolist())]
        served = unscale(f"({' + '.join([f'{float(model.intercept)!r}D', *weights])})", low, high)
        errors.append(F.expr(f"avg(abs(_y - greatest(0D, {served}))) AS t{i}"))
    scored = val.agg(*errors)
    names = F.array(*[F.lit(str(sorted(p.items()))) for p in points])
    return (
        scored.unpivot([], [f"t{i}" for i in range(len(points))], "trial", "val_mae")
        .withColumn("trial", F.substring("trial", 2, 10).cast("int"))
        .withColumn("params", F.element_at(names, F.col("trial") + 1))
        .select("trial", "params", "val_mae").orderBy("val_mae", "trial")
    )


def train_forecaster(
    features: DataFrame, keys: Sequence[str] = SERIES, step: int = HOUR, run_search: bool = True,
    trials: int = TRIALS, seed: int = 42, origin_stride: int = 1, save_to: str | None = None,
    run_id: str = "forecaster",
) -> dict:
    """Split, scale, (search), fit, test, save; returns model, metrics, params."""
    spark = features.sparkSession
    needed = [*FEATURE_COLUMNS, TARGET_COLUMN]
    quality.require_columns(features, needed)
    split_rows = stage(prepare.chrono_split(features.select(*keys, TIME, *needed), keys, step=step), "split-rows")
    prepare.require_sequences(split_rows)
    scaler = forecast.fit_scaler(split_rows, keys)
    params: dict = {}
    if run_search:
        best = tune_forecaster(split_rows, keys, step, trials, seed, origin_stride, scaler).first()
        params = search_points(trials, seed)[best["trial"]]
    fitted = forecast.fit_forecaster(split_rows, keys, step, forecast.estimator(**params), origin_stride, scaler)
    pairs = cut(forecast.predict_split(split_rows.where(F.col("split").isin("val", "test")), fitted))
    metrics = report.forecast_metrics(pairs, by=["split"])
    if save_to:
        artefacts.save_forecaster(spark, fitted, f"{save_to}/forecaster")
        artefacts.write_record(spark, params, f"{save_to}/best_params")
        artefacts.write_frame_record(metrics, f"{save_to}/metrics")
        history = training_history(spark, fitted.model, run_id)
        history.write.mode("overwrite").json(f"{save_to}/history")
        artefacts.log_run(spark, f"{save_to}/runs", run_id, "param", params or {"search": "off"})
        test = metrics.where(F.col("split") == "test").first()
        if test is not None:
            artefacts.log_run(spark, f"{save_to}/runs", run_id, "metric",
                              {f"test_{k}": test[k] for k in ("mae", "rmse", "smape")})
    return {"model": fitted, "metrics": metrics, "params": params, "pairs": pairs, "split_rows": split_rows}


def fit_in_rounds(
    split_rows: DataFrame, keys: Sequence[str] = SERIES, step: int = HOUR, settings: rounds.Settings | None = None,
    points: Sequence[rounds.Settings] = (), origin_stride: int = 1,
) -> dict:
    """A forecaster trained in rounds: model, trained (with the history), trials and the settings used.

    With ``points`` each is tried first and the one of least val_mae is used.
    The origins of both splits are written once; passing over them gives the
    sums, the trials' scores and the errors of all rounds.
    """
    scaler = forecast.fit_scaler(split_rows, keys)
    part = split_rows.where(F.col("split").isin("train", "val"))
    origins = stage(forecast.origin_frame(part, scaler, keys, origin_stride=origin_stride), "origins")
    rows = forecast.step_rows(origins, step).select("split", *forecast.MODEL_INPUTS, "label")
    sums = rounds.moments(rows, forecast.MODEL_INPUTS)
    trials = rounds.search(rows, sums, points) if points else []
    if trials:
        best = min(trials, key=lambda t: (t["val_mae"], t["trial"]))
        chosen = points[best["trial"]]
        # the trials stop early; the chosen settings get all rounds
        settings = rounds.Settings(chosen.learning_rate, chosen.momentum, chosen.l2, chosen.warmup)
    settings = settings or rounds.Settings()
    trained = rounds.train(sums, settings)
    held = rows.where(F.col("split") == ("val" if sums.rows("val") else "train"))
    trained.history["val_mae"] = rounds.absolute_errors(held, trained.models, forecast.MODEL_INPUTS)
    model = forecast.Forecaster(trained.model(), scaler, list(keys), step)
    return {"model": model, "trained": trained, "trials": trials, "settings": settings}


def train_in_rounds(
    features: DataFrame, keys: Sequence[str] = SERIES, step: int = HOUR, run_search: bool = True,
    trials: int = TRIALS, seed: int = 42, origin_stride: int = 1, save_to: str | None = None,
    run_id: str = "forecaster", gapless: bool = False,
) -> dict:
    """The training job: split, scale, search, train with validation history, test, save.

    Saved are the model, the best parameters, every trial, the history (loss,
    val_loss, val_mae and learning rate of each round), the accuracy by split,
    and in the run log the parameters, the test accuracy, best_val_loss and
    epochs_trained.
    """
    spark = features.sparkSession
    needed = [*FEATURE_COLUMNS, TARGET_COLUMN]
    quality.require_columns(features, needed)
    split_rows = stage(prepare.chrono_split(features.select(*keys, TIME, *needed), keys, step=step, gapless=gapless), "split-rows")
    prepare.require_sequences(split_rows)
    points = rounds.search_points(trials, seed) if run_search else []
    made = fit_in_rounds(split_rows, keys, step, points=points, origin_stride=origin_stride)
    trained = made["trained"]
    params = {k: v for k, v in asdict(made["settings"]).items() if k in rounds.SEARCH_SPACE}
    pairs = cut(forecast.predict_split(split_rows.where(F.col("split").isin("val", "test")), made["model"]))
    metrics = report.forecast_metrics(pairs, by=["split"])
    fitted = {"best_val_loss": trained.history["val_loss"][trained.best - 1], "epochs_trained": len(trained.models)}
    if save_to:
        artefacts.save_forecaster(spark, made["model"], f"{save_to}/forecaster")
        artefacts.write_record(spark, params, f"{save_to}/best_params")
        artefacts.write_frame_record(metrics, f"{save_to}/metrics")
        artefacts.write_record(spark, fitted, f"{save_to}/fit")
        if made["trials"]:
            spark.createDataFrame(made["trials"], TRIALS_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{save_to}/trials")
        history = artefacts.history_frame(spark, run_id, trained.history)
        history.write.mode("overwrite").json(f"{save_to}/history")
        artefacts.log_run(spark, f"{save_to}/runs", run_id, "param", params)
        test = metrics.where(F.col("split") == "test").first()
        artefacts.log_run(spark, f"{save_to}/runs", run_id, "metric",
                          fitted | {f"test_{k}": test[k] for k in ("mae", "rmse", "smape") if test is not None})
    return made | {"metrics": metrics, "params": params, "pairs": pairs, "split_rows": split_rows, **fitted}


def training_job(features: DataFrame, save_to: str, **options) -> dict:
    """``train_in_rounds`` as a job of its own: the saved parts are read back, and nothing else is left behind."""
    spark = features.sparkSession
    with owned_scratch(spark):
        made = train_in_rounds(features, save_to=save_to, **options)
    return {
        "model": artefacts.load_forecaster(spark, f"{save_to}/forecaster"),
        "metrics": artefacts.read_record(spark, f"{save_to}/metrics"),
        "history": artefacts.read_record(spark, f"{save_to}/history", artefacts.HISTORY_SCHEMA),
        "runs": artefacts.read_runs(spark, f"{save_to}/runs"),
        **{k: made[k] for k in ("params", "trials", "best_val_loss", "epochs_trained")},
    }


def training_history(spark: SparkSession, model: PipelineModel, run_id: str) -> DataFrame:
    """The objective after every iteration, where the solver iterates."""
    last = model.stages[-1]
    values = list(last.summary.objectiveHistory) if getattr(last, "hasSummary", False) else []
    return artefacts.history_frame(spark, run_id, {"loss": values})


def train_detector(
    features: DataFrame, keys: Sequence[str] = SERIES, step: int = HOUR, reconstruction: str = "profile",
    method: str = "p99", stride: int | None = None, save_to: str | None = None, **options,
) -> dict:
    """Split, filter, scale, cut windows, fit, set the threshold, test, save."""
    stride = stride or prepare.WINDOW_STRIDE
    quality.require_columns(features, DETECTOR_COLUMNS)
    rows = features.select(*keys, TIME, *DETECTOR_COLUMNS)
    split_rows = stage(prepare.chrono_split(rows, keys, step=step), "split-rows")
    train = split_rows.where(F.col("split") == "train").drop("pos", "n", "split", "split_pos", "split_n")
    detector = anomaly.fit_detector(train, keys, step, reconstruction, stride=stride, method=method, **options)
    parts = (detector.scaler, detector.profile, detector.autoencoder, list(keys))
    test = split_rows.where(F.col("split") == "test").drop("pos", "n")
    test = test.withColumnsRenamed({"split_pos": "pos", "split_n": "n"})
    errors = cut(anomaly.window_errors(test, parts, keys, stride, detector.length))
    flagged = anomaly.flag_windows(errors, detector.threshold, keys, severity="sigma")
    summary = anomaly.anomaly_summary(flagged, keys, decimals=None)
    counts = anomaly.severity_counts(flagged, keys)
    spread = errors.groupBy(*keys).agg(F.avg("error").alias("test_mean_error"), F.max("error").alias("test_max_error"))
    fitted = detector.threshold.select(*keys, F.col("mean").alias("train_mean_error"),
                                       F.col("std").alias("train_std_error"), "method")
    metrics = summary.join(counts, list(keys)).join(spread, list(keys)).join(fitted, list(keys))
    if save_to:
        spark = features.sparkSession
        artefacts.save_detector(spark, detector, f"{save_to}/detector")
        artefacts.write_frame_record(metrics, f"{save_to}/detector_metrics")
    return {"model": detector, "threshold": detector.threshold, "metrics": metrics, "flagged": flagged}
