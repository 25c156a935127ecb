"""Checks on a raw series table: profile, nulls, duplicates, gaps, validity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError
from ..schema import HOUR, RAW_RENAMES, SERIES, TIME
from ..session import cut
from . import axis

_FLOATS = (T.DoubleType, T.FloatType)


def rename_raw(df: DataFrame, names: dict[str, str] = RAW_RENAMES) -> DataFrame:
    """Source names to canonical names; absent ones are skipped, others kept."""
    return df.withColumnsRenamed(names)


def parse_time(df: DataFrame, time: str = TIME, strict: bool = True) -> DataFrame:
    """Text to timestamp. ``strict`` raises on bad text, otherwise it is null."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    return df.withColumn(time, parse(F.col(time)))


def sort_by_time(df: DataFrame, keys: Sequence[str] = (), time: str = TIME) -> DataFrame:
    """Ascending, unreadable times last."""
    return df.orderBy(*keys, F.col(time).asc_nulls_last())


def preview(df: DataFrame, rows: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def missing_value(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a floating-point column."""
    test = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, _FLOATS):
        test = test | F.isnan(column)
    return test


def profile(df: DataFrame, keys: Sequence[str] = SERIES, time: str = TIME) -> DataFrame:
    """Rows, columns and time span of each series."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.min(time).alias("first_ts"),
        F.max(time).alias("last_ts"),
    )


def column_types(df: DataFrame) -> DataFrame:
    """(position, column, type) of the schema; no data is read."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percent of every column in one pass, worst first."""
    columns = list(columns or df.columns)
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.coalesce(F.sum(missing_value(df, c).cast("bigint")), F.lit(0)).alias(c) for c in columns],
    )
    long = one.unpivot(["_rows"], columns, "column", "missing_count")
    percent = F.when(F.col("_rows") > 0, F.col("missing_count") * 100.0 / F.col("_rows"))
    return long.select("column", "missing_count", percent.alias("missing_percent")).orderBy(
        F.desc("missing_count"), "column"
    )


def duplicate_times(df: DataFrame, keys: Sequence[str] = SERIES, time: str = TIME) -> DataFrame:
    """Rows after the first of each time, per series. Repeated nulls count too."""
    return (
        df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_rows"))
        .groupBy(*keys).agg(F.sum(F.col("_rows") - 1).alias("n_duplicates"))
    )


def collapse_times(
    df: DataFrame, values: dict[str, str], keys: Sequence[str] = SERIES, time: str = TIME
) -> DataFrame:
    """One row per (series, time), e.g. ``{"load": "avg"}``.

    Copies are combined before the shuffle, so a time that is repeated very
    often costs one row per input partition.
    """
    return df.groupBy(*keys, time).agg(*[F.expr(f"{fn}(`{c}`)").alias(c) for c, fn in values.items()])


def split_rejects(
    df: DataFrame, keys: Sequence[str] = SERIES, time: str = TIME
) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows without a series or a readable time)."""
    bad = F.lit(False)
    for c in [*keys, time]:
        bad = bad | F.col(c).isNull()
    return df.where(~bad), df.where(bad)


def set_aside(
    df: DataFrame, keys: Sequence[str] = SERIES, time: str = TIME, min_rows: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(usable rows, table of what is left out): nothing is lost without a line in the table.

    The table has a row for each series (null where it has none) and reason,
    ``null_key``, ``null_time`` or ``too_few_rows``, with the number of rows.
    """
    keys = list(keys)
    usable, bad = split_rejects(df, keys, time)
    unnamed = F.lit(False)
    for c in keys:
        unnamed = unnamed | F.col(c).isNull()
    reasons = bad.groupBy(*keys, F.when(unnamed, "null_key").otherwise("null_time").alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))
    if min_rows <= 0:
        return usable, reasons
    short = cut(usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") < min_rows))
    kept = axis.attach(usable, short.select(*keys, F.lit(True).alias("_short")), keys).where(F.col("_short").isNull()).drop("_short")
    return kept, reasons.unionByName(short.select(*keys, F.lit("too_few_rows").alias("reason"), "n_rows"))


def missing_times(
    df: DataFrame, keys: Sequence[str] = SERIES, time: str = TIME, step: int = HOUR
) -> DataFrame:
    """Steps absent between the first and last row of each series."""
    usable, _ = split_rejects(df, keys, time)
    full = axis.spine(axis.series_bounds(usable, keys, time), keys, time, step)
    return full.join(usable.select(*keys, time), [*keys, time], "left_anti")


def time_difference(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """Distinct times of ``left`` that ``right`` does not have."""
    return left.select(*columns).subtract(right.select(*columns))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def violations(
    df: DataFrame, required: Sequence[str], min_rows: int, keys: Sequence[str] = SERIES
) -> DataFrame:
    """One row per broken rule: (keys..., rule, detail). Empty means valid."""
    missing = missing_columns(df, required)
    present = ", ".join(df.columns)
    if missing:
        spark = df.sparkSession
        return spark.range(1).select(
            *[F.lit(None).cast("string").alias(k) for k in keys],
            F.lit("missing_columns").alias("rule"),
            F.lit(f"missing: {', '.join(missing)}; present: {present}").alias("detail"),
        )
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.where(F.col("_rows") < min_rows).select(
        *keys,
        F.lit("too_few_rows").alias("rule"),
        F.concat(F.col("_rows").cast("string"), F.lit(f" rows; need at least {min_rows}")).alias("detail"),
    )


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise InputError(f"missing required columns: {missing}; present columns: {df.columns}")


def validate(
    df: DataFrame, required: Sequence[str], min_rows: int, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Return ``df`` unchanged, or raise with the missing columns / short series."""
    require_columns(df, required)
    short = violations(df, required, min_rows, keys)
    examples = short.orderBy(*keys).limit(5).collect()
    if examples:
        named = "; ".join(f"{[r[k] for k in keys]}: {r['detail']}" for r in examples)
        raise InputError(f"series too short ({named})")
    if df.isEmpty():
        raise InputError(f"0 rows; need at least {min_rows}")
    return df
