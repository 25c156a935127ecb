"""Forecast, extended forecast and anomaly scan of one feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anomaly, forecast, quality
from ..operators.anomaly import Detector
from ..operators.forecast import Forecaster
from ..schema import DETECTOR_COLUMNS, EXTENDED_HORIZON, FORECAST_HORIZON, MIN_ROWS_ANOMALY, MIN_ROWS_EXTENDED, TIME
from ..session import cut


def run_anomaly_detection(df: DataFrame, detector: Detector, time: str = TIME, strict: bool = True) -> dict:
    """``windows`` (all, flagged or not) and ``summary`` per series."""
    if strict:
        quality.validate(df, DETECTOR_COLUMNS, MIN_ROWS_ANOMALY, detector.keys)
    flagged = anomaly.detect(df, detector, time=time)
    used = df.groupBy(*detector.keys).agg(F.count(F.lit(1)).alias("rows_analyzed"))
    summary = anomaly.anomaly_summary(flagged, detector.keys).join(used, detector.keys)
    return {"windows": flagged, "summary": summary}


def full_analysis(df: DataFrame, forecaster: Forecaster | None, detector: Detector,
                  time: str = TIME, strict: bool = True) -> dict[str, DataFrame]:
    """All results of one table; without a forecaster the naive one is used."""
    keys = detector.keys
    if strict:
        quality.validate(df, DETECTOR_COLUMNS, MIN_ROWS_EXTENDED, keys)
    if forecaster is None:
        # no target looks back at a forecast, so the day is the week's first
        week = cut(forecast.seasonal_naive(df, EXTENDED_HORIZON, keys=keys, time=time, step=detector.step))
        day = week.where(F.col("step") <= FORECAST_HORIZON)
    else:
        day = forecast.run_forecast(df, forecaster, time, strict=False)
        week = forecast.run_extended_forecast(df, forecaster, time, strict=False)
    used = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_used"))
    found = run_anomaly_detection(df, detector, time, strict=False)
    return {"forecast": day.join(used, keys), "extended_forecast": week,
            "windows": found["windows"], "anomalies": found["summary"]}
