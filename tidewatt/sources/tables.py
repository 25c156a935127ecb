"""Readers and writers of series tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import parse_time, rename_raw, sort_by_time
from ..schema import FEATURE_SCHEMA, RAW_SCHEMA, TIME


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """A raw meter file, columns as in the file, types as in ``schema``.

    Columns are matched to the header by name and the schema is given, so the
    file is not read a first time to guess it.
    """
    header = spark.read.option("header", True).csv(path).columns
    types = {f.name: f for f in schema.fields}
    given = T.StructType([types.get(c, T.StructField(c, T.StringType())) for c in header])
    return spark.read.option("header", True).option("enforceSchema", False).schema(given).csv(path)


def clean_raw(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Canonical names, strict times, in time order."""
    return sort_by_time(parse_time(rename_raw(df)), keys)


def read_feature_csv(spark: SparkSession, path: str, schema: T.StructType = FEATURE_SCHEMA,
                     keys: Sequence[str] = ()) -> DataFrame:
    """A feature file; unreadable times become null and sort last."""
    df = read_raw_csv(spark, path, schema)
    if TIME not in df.columns:
        return df
    return sort_by_time(parse_time(df, strict=False), [k for k in keys if k in df.columns])


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet; a time column without a zone is taken as UTC wall-clock time."""
    df = spark.read.parquet(path)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, by series or month when ``partition_by`` says so.

    Rows are not gathered by the partition columns first: a long series is
    written by all the tasks that hold its rows.
    """
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)
