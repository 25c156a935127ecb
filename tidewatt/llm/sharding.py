"""Sharding along a Hilbert curve (operator 6).

Language, source and size of a document are quantised by quantiles of the
whole table and read as one place on a Hilbert curve; documents are sorted by
it and the order is cut into runs of equal numbers of rows (law ``rows``). A
run is a compact box of all three dimensions, so a reader with a filter on any
of them skips most files by their minima and maxima.

Copies of one text take the place of the copy with the smallest doc_id, so a
group of equal texts lies together in the order: only one of the cuts can
divide it, and a group larger than a shard has to be divided.

The position in the whole order is the number inside a range partition plus
the rows of the partitions before it; no task sees more than its range.

Defined results: null texts have size 1 and count as equal to empty ones;
null language or source comes first on its axis; rows that repeat get places
of their own; no rows give no rows; with fewer rows than shards some shards
stay empty; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatt.llm.common import partitions, read_table, text_key
from tidewatt.session import stage

SHARDS = 16
BITS = 5


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Places on the curve of points with integer coordinates below 2**bits (one row a point).

    From the highest bit down, the cell that a point lies in is taken in the
    order of a Gray code; coordinates are then flipped or swapped so that the
    curve of the cell ends where that of the next one begins.
    """
    x = axes.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(dims):
            high = (x[:, i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(high, below, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, dims - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[:, i] >> level) & 1)
    return out


def text_axis(column: str) -> Column:
    """The first seven bytes as a number: the order of strings as far as those tell, null as -1."""
    head = F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1).cast("long"))


def cut_points(df: DataFrame, axes: list[str], bits: int) -> list[list[int]]:
    """For each axis, the values that part its rows into 2**bits cells; a fixed number of them."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(a, shares, 10_000).alias(a) for a in axes]).first()
    return [sorted(set(row[a] or [])) for a in axes]


def curve_place(df: DataFrame, axes: list[str], bits: int = BITS) -> DataFrame:
    """``df`` with ``place``, its rows' position on the curve over the columns ``axes`` (longs)."""
    cuts = cut_points(df, axes, bits)

    @F.pandas_udf("long")
    def place(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            cells = [np.searchsorted(np.asarray(c, np.int64), s.to_numpy(np.int64), side="right") for c, s in zip(cuts, columns, strict=True)]
            yield pd.Series(hilbert(np.stack(cells, 1), bits))

    return df.withColumn("place", place(*axes))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``rank`` (from 0) in the order given and ``total``, the number of rows."""
    placed = stage(
        df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "ranked")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return placed.join(parts, "part").withColumn("rank", F.col("at") + F.col("before")).drop("part", "at", "before")


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, place, shard and slot of every row of ``docs`` (doc_id, text, lang, source)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *text_key(),
        text_axis("lang").alias("lang_axis"), text_axis("source").alias("source_axis")), "shard")
    axes = ["lang_axis", "source_axis", "size"]
    group = rows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "lang_axis", "source_axis")).alias("lead"), F.count(F.lit(1)).alias("n"))
    group = group.filter("n > 1").select("k1", "k2", F.col("lead.lang_axis").alias("lead_lang"), F.col("lead.source_axis").alias("lead_source"))
    led = rows.join(group, ["k1", "k2"], "left").withColumns({
        "lang_axis": F.coalesce("lead_lang", "lang_axis"), "source_axis": F.coalesce("lead_source", "source_axis")}).drop("lead_lang", "lead_source")
    order = ranked(curve_place(stage(led, "led"), axes, bits), ["place", "k1", "k2", "doc_id"])
    # the second term of slot is the first rank that falls into the shard
    return order.withColumn("shard", F.expr(f"cast(rank * {shards} div total as int)")).withColumn(
        "slot", F.col("rank") - F.expr(f"(shard * total + {shards} - 1) div {shards}")).select("doc_id", "size", "text_crc32", "place", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``docs`` below ``path``, a folder for each shard, in the order of the curve (doc_id has to be unique)."""
    placed = docs.join(shard(docs, shards).select("doc_id", "place", "shard", "slot"), "doc_id")
    placed.repartitionByRange(partitions(docs), "shard", "slot").sortWithinPartitions("shard", "slot").drop("slot", "place").write.partitionBy("shard").parquet(path)


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of all documents under the law ``rows``."""
    placed = shard(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place")
