"""Accuracy, KPI and training-history tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scaling import clamp_load
from ..schema import SERIES, SMAPE_EPSILON, SMAPE_FALLBACK


def smape_term(y: Column, yhat: Column) -> Column:
    return F.lit(2.0) * F.abs(y - yhat) / (F.abs(y) + F.abs(yhat) + F.lit(SMAPE_EPSILON))


def forecast_metrics(pairs: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAE, RMSE and sMAPE (percent) with predictions clamped at 0."""
    actual, predicted = F.col(y), clamp_load(F.col(yhat))
    error = actual - predicted
    measures = [
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(smape_term(actual, predicted)) * F.lit(100.0)).alias("smape"),
    ]
    return pairs.groupBy(*by).agg(*measures) if by else pairs.agg(*measures)


def health_score(rate: Column, smape: Column | float = SMAPE_FALLBACK) -> Column:
    smape = smape if isinstance(smape, Column) else F.lit(float(smape))
    return F.round(F.greatest(F.lit(0.0), F.lit(100.0) - rate - smape), 1)


def kpis(
    forecast: DataFrame, extended: DataFrame, anomalies: DataFrame, keys: Sequence[str] = SERIES,
    smape: float = SMAPE_FALLBACK, accuracy: DataFrame | None = None,
) -> DataFrame:
    """The headline numbers of each series.

    ``accuracy`` has the measured ``smape`` of each series; ``smape`` stands
    in for series that it does not have.
    """
    day = forecast.groupBy(*keys).agg(
        F.max("yhat").alias("peak_load"), F.min("yhat").alias("trough_load"),
        F.round(F.avg("yhat"), 1).alias("avg_24"))
    week = extended.groupBy(*keys).agg(F.round(F.avg("yhat"), 1).alias("avg_168"))
    flagged = anomalies.select(*keys, "n_anomalies", "anomaly_rate")
    wide = day.join(week, list(keys), "full").join(flagged, list(keys), "full")
    given = F.lit(float(smape))
    if accuracy is None:
        wide = wide.withColumn("smape", given)
    else:
        wide = wide.join(accuracy.select(*keys, "smape"), list(keys), "left").withColumn("smape", F.coalesce("smape", given))
    return wide.withColumn("health_score", health_score(F.col("anomaly_rate"), F.col("smape")))


def history_best(history: DataFrame) -> DataFrame:
    """Epochs run, the smallest value and its epoch, per run and metric."""
    return history.groupBy("run_id", "metric").agg(
        F.count(F.lit(1)).alias("epochs"), F.min("value").alias("best_value"),
        F.min_by("epoch", F.struct("value", "epoch")).alias("best_epoch"))
