"""Saved models, scalers, thresholds, records and the run log."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArtefactError
from ..operators.anomaly import Detector, LinearAutoencoder
from ..operators.forecast import Forecaster
from ..schema import HISTORY_SCHEMA, RUN_SCHEMA

FORECASTER_PARTS = {"forecast model": "model", "forecast scaler": "scaler", "forecast settings": "settings"}
DETECTOR_PARTS = {"detector scaler": "scaler", "detector threshold": "threshold",
                  "detector settings": "settings", "detector reconstruction": "reconstruction"}


# --- JSON records -----------------------------------------------------------

def write_record(spark: SparkSession, record: dict, path: str, mode: str = "overwrite") -> None:
    """One JSON object, e.g. parameters, metrics or a threshold."""
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode(mode).text(path)


def read_record(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Records with one JSON object a line; ``multi_line`` for files that hold one object over several lines."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def write_frame_record(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small result table (metrics, thresholds) as JSON lines."""
    df.write.mode(mode).json(path)


def history_frame(spark: SparkSession, run_id: str, history: dict[str, Sequence[float]]) -> DataFrame:
    """{metric: value per epoch} as (run_id, epoch, metric, value), epochs from 1."""
    rows = [(run_id, i, metric, float(v)) for metric, values in history.items() for i, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, HISTORY_SCHEMA)


# --- run log ----------------------------------------------------------------

def log_run(spark: SparkSession, path: str, run_id: str, kind: str, values: dict) -> None:
    """Append the parameters or metrics of one run."""
    rows = [(run_id, kind, str(k), str(v)) for k, v in values.items()]
    frame = spark.createDataFrame(rows, "run_id string, kind string, key string, value string")
    frame.withColumn("ts", F.current_timestamp()).select(*RUN_SCHEMA.fieldNames()).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


# --- models -----------------------------------------------------------------

def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def missing_parts(spark: SparkSession, root: str, parts: dict[str, str]) -> list[str]:
    """Every artefact that is absent, as ``label: path``."""
    paths = {label: f"{root}/{name}" for label, name in parts.items()}
    return [f"{label}: {path}" for label, path in paths.items() if not _exists(spark, path)]


def require_parts(spark: SparkSession, root: str, parts: dict[str, str]) -> None:
    missing = missing_parts(spark, root, parts)
    if missing:
        raise ArtefactError("parts of a model that are not there (has it been trained and saved?):\n" + "\n".join(missing))


def models_ready(spark: SparkSession, forecaster_root: str, detector_root: str) -> bool:
    return not (missing_parts(spark, forecaster_root, FORECASTER_PARTS)
                or missing_parts(spark, detector_root, DETECTOR_PARTS))


def _read_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_forecaster(spark: SparkSession, fitted: Forecaster, root: str) -> None:
    fitted.model.write().overwrite().save(f"{root}/model")
    fitted.scaler.write.mode("overwrite").parquet(f"{root}/scaler")
    write_record(spark, {"keys": fitted.keys, "step": fitted.step}, f"{root}/settings")


def load_forecaster(spark: SparkSession, root: str) -> Forecaster:
    require_parts(spark, root, FORECASTER_PARTS)
    settings = _read_settings(spark, f"{root}/settings")
    return Forecaster(PipelineModel.load(f"{root}/model"), spark.read.parquet(f"{root}/scaler"),
                      settings["keys"], settings["step"])


def save_detector(spark: SparkSession, detector: Detector, root: str) -> None:
    detector.scaler.write.mode("overwrite").parquet(f"{root}/scaler")
    detector.threshold.write.mode("overwrite").parquet(f"{root}/threshold")
    if detector.autoencoder is None:
        detector.profile.write.mode("overwrite").parquet(f"{root}/reconstruction")
    else:
        model = detector.autoencoder
        rows = [(i, float(m), [float(x) for x in c]) for i, (m, c) in enumerate(zip(model.mean, model.components))]
        frame = spark.createDataFrame(rows, "cell int, mean double, components array<double>")
        frame.write.mode("overwrite").parquet(f"{root}/reconstruction")
    kind = "profile" if detector.autoencoder is None else "pca"
    write_record(spark, {"keys": detector.keys, "step": detector.step, "length": detector.length,
                         "reconstruction": kind}, f"{root}/settings")


def load_detector(spark: SparkSession, root: str) -> Detector:
    require_parts(spark, root, DETECTOR_PARTS)
    settings = _read_settings(spark, f"{root}/settings")
    rebuilt = spark.read.parquet(f"{root}/reconstruction")
    profile = autoencoder = None
    if settings["reconstruction"] == "profile":
        profile = rebuilt
    else:
        # one row per window cell: the size of the model, not of the data
        cells = rebuilt.orderBy("cell").collect()
        autoencoder = LinearAutoencoder(np.array([r["mean"] for r in cells]),
                                        np.array([r["components"] for r in cells]))
    return Detector(spark.read.parquet(f"{root}/scaler"), spark.read.parquet(f"{root}/threshold"),
                    settings["keys"], profile, autoencoder, settings["length"], settings["step"])
