"""Time axis, row positions and overlapping chunks.

A series may be any length, and one series may hold a large share of all
rows, so no operator here or elsewhere windows over a whole series. Rows are
grouped by (series, block) or (series, chunk), both of a fixed number of time
steps, and only block totals are summed over a series.

Positional operators expect one row per (series, time) and no null in either;
``quality.duplicate_times``, ``quality.collapse_times`` and
``quality.split_rejects`` report and repair the exceptions.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError
from ..schema import HOUR, SERIES, TIME
from ..session import cut

# Rows of one series handled by one window task: large enough that a 168-row
# overlap costs about 4 %, small enough to sort in memory.
CHUNK_ROWS = 4096
# Block totals added up by one task before the next level takes over.
FAN = 4096
# Parameter tables are broadcast up to this many rows and this many values
# (32 MB of doubles).
BROADCAST_ROWS = 100_000
BROADCAST_VALUES = 4_000_000
# Tasks over which one long series is spread when its parameters are not
# broadcast, and the rows of it that are left to one task.
SALTS = 32
SALT_ROWS = 100_000
# Column that says in which block of time a row lies, kept in tables that are
# staged by (series, block): whole series need not meet, and no row is shuffled again.
BLOCK = "_time_block"
# Rows of a dense axis made by one task, and the most tasks (Spark allows 100,000 buckets).
TASK_ROWS = 1 << 17
MAX_PARTS = 50_000


def tick(time: str | Column = TIME, step: int = HOUR) -> Column:
    """Number of whole steps since 1970, the position on a gap-free axis."""
    return F.floor(F.unix_seconds(time) / F.lit(step))


def from_tick(ticks: Column, step: int = HOUR) -> Column:
    return F.timestamp_seconds(ticks * F.lit(step))


def shift_time(time: str | Column, steps: Column, step: int = HOUR) -> Column:
    return F.timestamp_seconds(F.unix_seconds(time) + steps * F.lit(step))


def with_position(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    time: str = TIME,
    step: int = HOUR,
    block_rows: int = CHUNK_ROWS,
    order: Sequence[str] = (),
) -> DataFrame:
    """Add ``pos`` (dense, 0-based, in time order) and ``n`` (rows in the series).

    Rows are numbered inside blocks of time; a small table of block totals
    says how many rows precede each block. ``time`` may also be a numeric row
    number, for tables without a time axis. Blocks that ``df`` already has
    (``BLOCK``) are used and kept.
    """
    keys = list(keys)
    block, blocked = BLOCK, df.where(F.col(time).isNotNull())
    if BLOCK not in df.columns:
        numeric = isinstance(df.schema[time].dataType, T.NumericType)
        seconds = F.col(time) * F.lit(step) if numeric else F.unix_seconds(time)
        block, blocked = "_block", blocked.withColumn("_block", F.floor(seconds / F.lit(step * block_rows)))
    totals = blocked.groupBy(*keys, F.col(block).alias("_block")).agg(F.count(F.lit(1)).alias("_rows"))
    # numbered before the join: the sort of the window also serves the join
    inside = Window.partitionBy(*keys, block).orderBy(time, *order)
    return (
        blocked.withColumn("_at", F.row_number().over(inside))
        .join(_block_offsets(totals, keys).withColumnRenamed("_block", block), [*keys, block])
        .withColumn("pos", F.col("_before") + F.col("_at") - F.lit(1))
        .drop("_block", "_before", "_at")
    )


def gapless_position(df: DataFrame, keys: Sequence[str] = SERIES, time: str = TIME, step: int = HOUR) -> DataFrame:
    """``with_position`` for series without gaps: ``pos`` is the distance from the first row, so nothing is numbered or sorted.

    First row and number of rows of each series are one small table. It is
    checked: a series with a gap, a repeated or a shifted time is an error.
    Steps count as gap-free when range, number, sum and sum of squares are
    those of consecutive numbers.
    """
    keys = list(keys)
    rows = df.where(F.col(time).isNotNull())
    seconds, at = F.unix_seconds(time), tick(time, step)
    wide = at.cast("decimal(20,0)")
    spans = cut(rows.groupBy(*keys).agg(
        F.min(seconds).alias("_first"), F.min(at).alias("_from"), F.max(at).alias("_to"), F.count(F.lit(1)).alias("n"),
        F.sum(wide).alias("_sum"), F.sum((wide * wide).cast("decimal(38,0)")).alias("_squares"),
        (F.min(seconds % F.lit(step)) != F.max(seconds % F.lit(step))).alias("_shifted")))
    n, low, high = "cast(n AS DECIMAL(20,0))", "cast(_from AS DECIMAL(20,0))", "cast(_to AS DECIMAL(20,0))"
    below = "cast({0} * ({0} - 1) AS DECIMAL(30,0)) * (2 * {0} - 1)"  # six times the squares from 1 to {0} - 1
    above = below.format(f"({high} + 1)")
    whole = f"_to - _from = n - 1 AND 2 * _sum = {n} * ({low} + {high}) AND 6 * _squares = {above} - {below.format(low)}"
    examples = spans.where(F.col("_shifted") | ~F.expr(whole)).orderBy(*keys).limit(5).collect()
    if examples:
        raise InputError(f"series with gaps or repeated times: {[[r[k] for k in keys] for r in examples]}")
    placed = attach(rows, spans.select(*keys, "_first", "n"), keys)
    return placed.withColumn("pos", F.floor((seconds - F.col("_first")) / F.lit(step))).drop("_first")


def _block_offsets(totals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block) -> rows before the block, rows in the series; two levels."""
    earlier = (Window.unboundedPreceding, -1)
    levelled = totals.withColumn("_upper", F.floor(F.col("_block") / F.lit(FAN)))
    per_series = Window.partitionBy(*keys)
    upper = (
        levelled.groupBy(*keys, "_upper").agg(F.sum("_rows").alias("_rows"))
        .select(
            *keys, "_upper",
            F.coalesce(F.sum("_rows").over(per_series.orderBy("_upper").rowsBetween(*earlier)),
                       F.lit(0)).alias("_base"),
            F.sum("_rows").over(per_series).alias("n"),
        )
    )
    per_upper = Window.partitionBy(*keys, "_upper").orderBy("_block").rowsBetween(*earlier)
    return levelled.join(upper, [*keys, "_upper"]).select(
        *keys, "_block",
        (F.col("_base") + F.coalesce(F.sum("_rows").over(per_upper), F.lit(0))).alias("_before"),
        "n",
    )


def with_chunks(
    df: DataFrame,
    position: Column,
    back: int = 0,
    ahead: int = 0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Copy rows into the chunks that need them.

    A chunk gets its own rows, the ``back`` rows before and the ``ahead`` rows
    after them. Adds ``_chunk`` (group by it), ``_own`` (true on the chunk's
    own rows, keep only those afterwards) and ``_at`` (the position).
    """
    rows = F.lit(chunk_rows)
    first = F.floor((F.col("_at") - F.lit(ahead)) / rows)
    last = F.floor((F.col("_at") + F.lit(back)) / rows)
    return (
        df.withColumn("_at", position)
        .withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col("_chunk") == F.floor(F.col("_at") / rows))
    )


def chunk_window(keys: Sequence[str] = SERIES):
    return Window.partitionBy(*keys, "_chunk").orderBy("_at")


def chunk_window_sql(keys: Sequence[str] = SERIES) -> str:
    """``chunk_window`` as SQL text."""
    return f"PARTITION BY {', '.join(f'`{k}`' for k in [*keys, '_chunk'])} ORDER BY _at"


def drop_chunks(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_at", "_chunk", "_own")


def keep_block(chunked: DataFrame, parts: int) -> DataFrame:
    """Add the chunk as ``BLOCK``, which says that (series, chunk) are dealt to ``parts`` tasks."""
    return chunked.withColumn(BLOCK, F.col("_chunk").alias(BLOCK, metadata={"parts": parts}))


def block_of(df: DataFrame) -> list[str]:
    """``BLOCK`` where ``df`` has it, to be selected with other columns."""
    return [BLOCK] if BLOCK in df.columns else []


def dealing(df: DataFrame, keys: Sequence[str] = SERIES) -> dict:
    """``by`` and ``parts`` that ``stage`` needs to keep the rows of ``df`` where they are."""
    parts = df.schema[BLOCK].metadata.get("parts", 0) if block_of(df) else 0
    return {"by": [*keys, BLOCK], "parts": parts} if parts else {}


def last_rows(
    df: DataFrame, count: int, keys: Sequence[str] = SERIES, time: str = TIME
) -> DataFrame:
    """The newest ``count`` rows of every series.

    The rank filter is applied before the shuffle as well, so a long series
    sends at most ``count`` rows per input partition.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= count).drop("_rank")


def series_bounds(df: DataFrame, keys: Sequence[str] = SERIES, time: str = TIME) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))


def global_bounds(bounds: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Give every series the range of all series."""
    whole = bounds.agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    # one row by construction
    return bounds.select(*keys).crossJoin(F.broadcast(whole))


def spine(
    bounds: DataFrame, keys: Sequence[str] = SERIES, time: str = TIME, step: int = HOUR,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Every step from ``first_ts`` to ``last_ts`` of each series.

    The range is expanded in two strides with a shuffle between them, so that
    one long series is written out by many tasks.
    """
    last = F.floor((F.unix_seconds("last_ts") - F.unix_seconds("first_ts")) / F.lit(step))
    starts = bounds.withColumn("_last", last).withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"), F.lit(chunk_rows).cast("bigint")))
    )
    until = F.least(F.col("_last"), F.col("_from") + F.lit(chunk_rows - 1))
    return (
        starts.repartition(*keys, "_from")
        .withColumn("_at", F.explode(F.sequence(F.col("_from"), until)))
        .select(*keys, shift_time("first_ts", F.col("_at"), step).alias(time))
    )


def densify(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    time: str = TIME,
    step: int = HOUR,
    fill: dict | None = None,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """One row for every step of each series; absent rows get ``fill`` values.

    ``bounds`` defaults to each series' own first and last row.
    """
    keys = list(keys)
    if bounds is None:
        bounds = series_bounds(df, keys, time)
    full = spine(bounds, keys, time, step).join(df, [*keys, time], "left")
    return full.fillna(fill) if fill else full


def dense_rows(bounds: DataFrame, step: int = HOUR) -> int:
    """Rows that ``densify`` makes for ``bounds``."""
    steps = F.floor((F.unix_seconds("last_ts") - F.unix_seconds("first_ts")) / F.lit(step)) + F.lit(1)
    return bounds.agg(F.sum(F.greatest(steps, F.lit(0)))).first()[0] or 0


def dense_parts(bounds: DataFrame, step: int = HOUR) -> int:
    """Tasks for the rows that ``densify`` makes for ``bounds``."""
    # two at least: one part alone would be no part by key
    return min(max(2, math.ceil(dense_rows(bounds, step) / TASK_ROWS)), MAX_PARTS)


def dense_chunks(
    df: DataFrame, bounds: DataFrame, parts: int, keys: Sequence[str] = SERIES, time: str = TIME, step: int = HOUR,
    fill: dict | None = None, back: int = 0, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``with_chunks`` of ``densify``, by the time of a row, without a shuffle of the dense rows.

    Only the rows of ``df``, with their copies, and one start of each chunk
    are dealt by (series, chunk) to ``parts`` tasks. There each row, and each
    start, is followed by the steps that are absent up to the next row. Chunks
    without rows of their own are left out. ``bounds`` has one row per series.
    """
    keys = list(keys)
    rows, width = F.lit(chunk_rows), F.lit(step)
    values = [c for c in df.columns if c not in (*keys, time)]
    first = F.unix_seconds("first_ts")
    ends = bounds.select(*keys, F.floor(first / width).alias("_from"), F.pmod(first, width).alias("_off"),
                         F.floor((F.unix_seconds("last_ts") - first) / width).alias("_steps")).where("_steps >= 0")
    until = F.col("_from") + F.col("_steps")
    starts = ends.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("_from") / rows), F.floor(until / rows)))).select(
        *keys, "_chunk", F.greatest("_from", F.col("_chunk") * rows - F.lit(back)).alias("_at"), "_off",
        F.least(until, (F.col("_chunk") + F.lit(1)) * rows - F.lit(1)).alias("_until"))
    # like a join by time: rows without a key or a whole second meet no step
    seconds = F.unix_seconds(time)
    known = df.where(F.timestamp_seconds(seconds) == F.col(time)).dropna("any", subset=keys)
    copied = with_chunks(known, F.floor(seconds / width), back=back, chunk_rows=chunk_rows)
    copied = copied.select(*keys, "_chunk", "_at", F.pmod(seconds, width).alias("_off"), F.lit(None).cast("bigint").alias("_until"),
                           F.lit(True).alias("_real"), *values)
    dealt = copied.unionByName(starts.withColumn("_real", F.lit(False)), allowMissingColumns=True).repartition(parts, *keys, "_chunk")
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_at", "_real")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = lambda c: F.min(F.when(~F.col("_real"), F.col(c))).over(whole)
    placed = dealt.withColumns({"_low": start("_at"), "_high": start("_until"), "_shift": start("_off")})
    placed = placed.where((F.col("_off") == F.col("_shift")) & F.col("_at").between(F.col("_low"), F.col("_high")))
    # the last absent step behind a row, or the row itself if the next one follows at once or has the same time
    behind = F.coalesce(F.lead("_at").over(inside), F.col("_high") + F.lit(1)) - F.lit(1)
    spread = placed.withColumn("_behind", F.when(F.col("_real"), F.greatest("_at", behind)).otherwise(behind)).where("_behind >= _at")
    made = spread.withColumn("_step", F.explode(F.sequence("_at", "_behind")))
    own = F.col("_real") & (F.col("_step") == F.col("_at"))
    full = made.select(
        *keys, F.timestamp_seconds(F.col("_step") * width + F.col("_shift")).alias(time),
        *[F.when(own, F.col(c)).alias(c) for c in values], F.col("_step").alias("_at"), "_chunk",
        (F.col("_chunk") == F.floor(F.col("_step") / rows)).alias("_own"))
    return full.fillna(fill) if fill else full


def attach(df: DataFrame, params: DataFrame, keys: Sequence[str] = SERIES, values: int | None = None) -> DataFrame:
    """Put the parameters of a series (scaler, threshold, profile) on its rows.

    ``params`` has one row per series and should already be materialised: its
    rows are counted here. A small one is broadcast and ``df`` is not shuffled.
    Beyond that, rows that have their block (``BLOCK``) are joined by (series,
    block), with one copy of ``params`` for each block of a series; rows staged
    by block are not shuffled. Others are joined by (series, salt): a series of
    more than ``SALT_ROWS`` rows, which are counted, gets up to ``SALTS`` salts,
    a hash of the row, and as many copies of its ``params``; all others get one.
    A long series is then spread over tasks, and since the salt is no column of
    the result, what groups by chunk or window afterwards shuffles by its own
    keys instead of keeping a whole series together. Rows of a series without parameters
    are kept, with nulls. ``values`` is the number of values in a row of
    ``params``, where its columns are arrays.
    """
    keys = list(keys)
    if not keys:
        # an aggregate without grouping: one row by construction
        return df.crossJoin(F.broadcast(params))
    bound = min(BROADCAST_ROWS, BROADCAST_VALUES // (values or len(params.columns)))
    if params.limit(bound + 1).count() <= bound:
        return df.join(F.broadcast(params), keys, "left")
    if BLOCK in df.columns:
        copies = params.join(df.select(*keys, BLOCK).distinct(), keys)
        return df.join(copies.hint("shuffle_hash"), [*keys, BLOCK], "left")
    rows, copies = salted(df, params, keys)
    return rows.join(copies, [*keys, "_salt"], "left").drop("_salt")


def salted(df: DataFrame, params: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with its ``_salt`` and ``params`` once for each salt of its series."""
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > SALT_ROWS)
    long = cut(long.select(*keys, F.least(F.ceil(F.col("_rows") / SALT_ROWS), F.lit(SALTS)).alias("_salts")))
    if long.isEmpty():
        counted, copied = df.withColumn("_salts", F.lit(1)), params.withColumn("_salts", F.lit(1))
    else:
        # few by their size: each has many rows
        counted, copied = (x.join(F.broadcast(long), keys, "left") for x in (df, params))
    salts = F.coalesce("_salts", F.lit(1)).cast("bigint")
    # rows without a series meet no parameters and may lie anywhere
    unknown = functools.reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    rows = counted.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.when(unknown, F.lit(SALTS)).otherwise(salts))).drop("_salts")
    copies = copied.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - F.lit(1)))).drop("_salts")
    return rows, copies
