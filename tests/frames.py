"""Small hand-made series."""

import datetime as dt

import numpy as np
import pandas as pd

START = pd.Timestamp("2024-03-01")


def series(spark, loads, name="a", start=START, skip=()):
    """One hourly series; ``skip`` leaves out hours by index."""
    rows = [(name, (start + pd.Timedelta(hours=i)).to_pydatetime().replace(tzinfo=dt.timezone.utc), float(v))
            for i, v in enumerate(loads) if i not in set(skip)]
    df = spark.createDataFrame(rows, "series_id string, timestamp timestamp, load double")
    return df.selectExpr("*", "load * 0.5 AS temperature", "load * 0.25 AS humidity")


def noisy(n, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 100 + 30 * np.sin(2 * np.pi * t / 24) + 10 * np.sin(2 * np.pi * t / 168) + rng.normal(0, 3, n)


def pdf(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)
