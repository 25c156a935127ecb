"""Column names, table schemas and fixed values shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Names, orders and lengths that the results depend on.

RAW_RENAMES = {
    "datetime": "timestamp",
    "nat_demand": "load",
    "T2M_toc": "temperature",
    "QV2M_toc": "humidity",
    "WS10M_toc": "wind_speed",
    "PRECTOTCORR_toc": "precipitation",
}

FEATURE_COLUMNS = [
    "temperature", "humidity",
    "is_weekend", "is_holiday",
    "hour_sin", "hour_cos",
    "dayofweek_sin", "dayofweek_cos",
    "month_sin", "month_cos",
    "lag_1", "lag_24", "lag_168",
    "rolling_mean_24", "rolling_std_24", "rolling_mean_168",
]
TARGET_COLUMN = "load"
DETECTOR_COLUMNS = [*FEATURE_COLUMNS, TARGET_COLUMN]

SEQUENCE_LENGTH = 168
FORECAST_HORIZON = 24
EXTENDED_HORIZON = 168
WINDOW_LENGTH = 24
WINDOW_STRIDE = 24
TRAIN_RATIO = 0.70
VAL_RATIO = 0.15
FILTER_SIGMAS = 3.0
TRIALS = 20
MAX_ROUNDS = 100
PATIENCE = 12
WARMUP_ROUNDS = 5
RATE_FACTOR = 0.5
RATE_PATIENCE = 5
MIN_RATE = 1e-7
SEARCH_ROUNDS = 25
SEARCH_PATIENCE = 5
BOTTLENECK = 32

MIN_ROWS_FORECAST = 168
MIN_ROWS_ANOMALY = 24
MIN_ROWS_EXTENDED = 192

BAND_MARGIN = 72.9
EXTENDED_MARGIN_FACTOR = 1.5
SMAPE_FALLBACK = 6.0
SMAPE_EPSILON = 1e-8
MAX_ERROR_BUFFER = 1.05

SEVERITY_LEVELS = ["normal", "low", "medium", "high"]
SERVED_CUTS = (0.25, 0.75)
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
# --- end of fixed values ----------------------------------------------------

# The number of standard deviations that separates low / medium / high when
# severity is measured against the spread of the training errors.
SIGMA_CUTS = (1.0, 2.0)

SERIES = ["series_id"]
TIME = "timestamp"
HOUR = 3600
DAY = 86400

RAW_SCHEMA = T.StructType([
    T.StructField("datetime", T.StringType()),
    T.StructField("nat_demand", T.DoubleType()),
    T.StructField("T2M_toc", T.DoubleType()),
    T.StructField("QV2M_toc", T.DoubleType()),
    T.StructField("WS10M_toc", T.DoubleType()),
    T.StructField("PRECTOTCORR_toc", T.DoubleType()),
])

FEATURE_SCHEMA = T.StructType(
    [T.StructField("series_id", T.StringType()), T.StructField("timestamp", T.StringType()),
     T.StructField("load", T.DoubleType())]
    + [T.StructField(c, T.IntegerType() if c.startswith("is_") else T.DoubleType())
       for c in FEATURE_COLUMNS]
)

FORECAST_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("origin_ts", T.TimestampType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("yhat", T.DoubleType()),
])

HISTORY_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])
