"""Mixing sources to target weights by systematic sampling (operator 7).

Every source gets a target, in words; its rate is target over size, the
expected copies of each of its documents. Documents of a source are put in
order, their expected copies are summed up along it, and one offset for the
source is added: a document is emitted once for each whole number that its
step crosses. The order is by size, so that long and short documents are met
in proportion and the words taken come near the target.

No window runs over a source: rows are dealt by range, numbered inside their
partition, and a table with a row for each (source, partition) gives what
lies before. A source that holds a third of all rows is thereby many parts.

Defined results: a null text has size 0; null is a source of its own, last in
order; a source without words has target 0 and no copies; no rows give no
rows; rows that repeat are documents of their own; other columns of the
input, whatever their names, are kept by ``mix`` and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatt.llm.common import partitions, read_table
from tidewatt.session import stage

WEIGHTS = (1, 2, 3)
LIMIT = 3
OFFSET_SALT = "mix-1:"
#: Copies of one row that are emitted by one task, where rows are alike in everything.
COPY_BLOCK = 4096


def word_count(column: str) -> Column:
    return F.coalesce(F.expr(rf"regexp_count(`{column}`, '[^\\x20\\x09-\\x0D]++')"), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Target of each source: source, source_size, target; ``sizes`` has source and source_size.

    Filled sources are found in order of the share at which they fill; the
    share that the rest get is the largest seen on the way.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * limit
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    share = (F.sum("source_size").over(whole) - filled) / left
    return (
        sizes.withColumn("weight", weight).withColumn("share", share)
        .withColumn("share", F.max("share").over(whole))
        .select("source", "source_size", F.least(F.col("source_size") * F.lit(float(limit)), F.col("share") * F.col("weight")).alias("target"))
    )


def copies(docs: DataFrame, order: list[str], weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``docs`` (with columns source and size) and, of each row, source_size, target and n_copies.

    ``order`` names the columns that order rows of equal size.
    """
    placed = stage(
        docs.repartitionByRange(partitions(docs), "source", "size", *order).sortWithinPartitions("source", "size", *order)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "mix")
    parts = placed.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    share = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, limit)
    parts = parts.alias("p").join(share.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        F.col("p.source").alias("p_source"), F.col("part").alias("p_part"), "low", "before", "source_size", "target")
    rank = F.col("at") - F.col("low") + F.col("before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(OFFSET_SALT), F.coalesce("source", F.lit("\0"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    crossed = F.floor(rate * (rank + 1) + offset) - F.floor(rate * rank + offset)
    return (
        placed.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
        .withColumn("n_copies", F.least(crossed, F.lit(limit)).cast("long"))
        .drop("p_source", "p_part", "low", "before", "at", "part")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it.

    Numbers are given to narrow rows (a key of each row and its size); texts
    are joined to the copies once, by that key.
    """
    names = docs.columns
    keyed = docs.select("*", *_row_key(docs))
    narrow = keyed.select("__m1", "__m2", "source", word_count("text").alias("size"), "doc_id", F.xxhash64("text").alias("h"))
    counted = copies(narrow, ["doc_id", "h", "__m1", "__m2"], weights, limit).groupBy("__m1", "__m2")
    taken = counted.agg(F.sum("n_copies").alias("__n"), F.count(F.lit(1)).alias("__rows")).filter("__n > 0")
    taken = stage(taken, "taken")
    single = keyed.join(taken.filter("__rows = 1").drop("__rows"), ["__m1", "__m2"])
    several = stage(taken.filter("__rows > 1").drop("__rows"), "several")
    if not several.isEmpty():  # rows alike in everything: one of them stands for all
        row = F.struct(*[F.col(f"`{c}`") for c in names])
        lead = keyed.join(several, ["__m1", "__m2"]).groupBy("__m1", "__m2", "__n").agg(F.first(row).alias("__row"))
        lead = lead.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {COPY_BLOCK}"))))
        lead = lead.withColumn("__n", F.least(F.lit(COPY_BLOCK).cast("long"), F.col("__n") - F.col("__block") * COPY_BLOCK))
        lead = lead.repartition("__m1", "__m2", "__block")
        single = single.unionByName(lead.select("__m1", "__m2", *[F.col(f"__row.`{c}`").alias(c) for c in names], "__n"))
    return single.select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__copy")).drop("__copy")


def _row_key(docs: DataFrame) -> list[Column]:
    """Two columns that name a row: 128 bits of two hashes over all its columns, nulls apart from values."""
    parts = []
    for field in docs.schema.fields:
        column = F.col(f"`{field.name}`")
        plain = "map" not in field.dataType.simpleString()  # maps can't be hashed
        parts += [column.isNull(), column if plain else F.to_json(F.struct(column))]
    return [F.xxhash64(F.lit(2), *parts).alias("__m1"), F.xxhash64(F.lit(3), *parts).alias("__m2")]


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and words taken of all documents."""
    docs = stage(read_table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size")), "sizes")
    return copies(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([1, 2, 3])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
f AS (SELECT *, (sum(source_size) OVER ()
        - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
     / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS share FROM w),
t AS (SELECT source, source_size, least(source_size * 3.0::DOUBLE, max(share) OVER () * weight) AS target,
        ('0x' || substr(md5('{OFFSET_SALT}' || coalesce(source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1)::DOUBLE AS i
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(floor(rate * (i + 1) + u) - floor(rate * i + u), 3) * size)::BIGINT AS taken FROM r
"""
