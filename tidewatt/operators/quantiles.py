"""Exact quantiles with linear interpolation, for groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in the memory of
one task. Here an approximate sketch, which merges before the shuffle, first
brackets each quantile, and an exact pass counts the rows below, above and, for each
distinct value, inside the bracket. A bracket with many distinct values is
parted into equal ranges, whose rows are counted; only the range that holds
the wanted rank is looked at further, until it has few values. So nothing but
``PARTS`` counts or ``ORDERED`` values of a group is ever put in order by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .axis import attach

# The sketch is off by at most 1/ACCURACY of the rows of a group, so a bracket
# holds about 4/ACCURACY of them.
ACCURACY = 100_000
# Ranges that a bracket is parted into, and distinct values that are put in order.
PARTS = 1024
ORDERED = 4096


def _label(prob: float) -> str:
    return f"q{round(prob * 100):d}" if abs(prob * 100 - round(prob * 100)) < 1e-9 else f"q{prob}"


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
    names: Sequence[str] | None = None, accuracy: int = ACCURACY, ordered: int = ORDERED, parts: int = PARTS,
) -> DataFrame:
    """One row per group with a column per quantile (``q25``, ``q99`` ...).

    Null and NaN values are left out. The result does not depend on the
    accuracy of the sketch; a bracket that missed would raise, not guess.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    names = list(names or [_label(p) for p in probs])
    values = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).alias("_v"))

    margin = 2.0 / accuracy
    sketch = cut(values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [max(0.0, p - margin) for p in probs], accuracy).alias("_lo"),
        F.percentile_approx("_v", [min(1.0, p + margin) for p in probs], accuracy).alias("_hi"),
    ))

    # One counted cell per value inside the bracket, one for all below it and
    # one for all above it.
    low, high = F.element_at("_lo", F.col("_q") + 1), F.element_at("_hi", F.col("_q") + 1)
    cells = cut(
        attach(values, sketch, keys)
        .withColumn("_q", F.explode(F.array(*[F.lit(i) for i in range(len(probs))])))
        .withColumn("_side", F.when(F.col("_v") < low, -1).when(F.col("_v") > high, 1).otherwise(0))
        .withColumn("_cell", F.when(F.col("_side") == 0, F.col("_v")))
        .groupBy(*keys, "_q", "_side", "_cell")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )
    prob = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_q") + 1)
    side = F.col("_side")
    edges = cells.groupBy(*keys, "_q").agg(
        F.coalesce(F.sum(F.when(side < 0, F.col("_rows"))), F.lit(0)).alias("_below"),
        F.coalesce(F.sum(F.when(side == 0, F.col("_rows"))), F.lit(0)).alias("_inside"),
        F.max(F.when(side < 0, F.col("_max"))).alias("_under"), F.min(F.when(side > 0, F.col("_min"))).alias("_over"),
        F.min("_cell").alias("_from"), F.max("_cell").alias("_to"), F.count("_cell").alias("_cells"),
    )
    edges = attach(edges, sketch.select(*keys, "_n"), keys).withColumn("_rank", prob * (F.col("_n") - 1))
    # the two rows that a quantile lies between: _need is their place inside the bracket
    ends = F.array(F.struct(F.lit(0).alias("_end"), F.floor("_rank").alias("_index")),
                   F.struct(F.lit(1).alias("_end"), F.ceil("_rank").alias("_index")))
    wanted = edges.withColumn("_e", F.explode(ends)).select("*", "_e.*").drop("_e").withColumn("_need", F.col("_index") - F.col("_below"))
    need = F.col("_need")
    outside = (
        F.when(need == -1, F.col("_under")).when(need == F.col("_inside"), F.col("_over"))
        .otherwise(F.raise_error(F.lit("quantile sketch missed its bracket; raise accuracy")).cast("double"))
    )
    wanted = cut(wanted.withColumn("_outside", F.when((need < 0) | (need >= F.col("_inside")), outside)))
    inside = cells.where(side == 0).select(*keys, "_q", "_cell", "_rows")
    narrow = wanted.where(F.col("_outside").isNull()).select(*keys, "_q", "_end", "_need", "_from", "_to", "_cells")
    found = _ranked(inside, _narrowed(inside, narrow, keys, ordered, parts), keys)
    out = wanted.join(found, [*keys, "_q", "_end"], "left").groupBy(*keys, "_q").agg(
        *[F.max(F.when(F.col("_end") == i, F.coalesce("_outside", "_found"))).alias(n) for i, n in ((0, "_a"), (1, "_b"))],
        F.first("_rank").alias("_rank"))
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.floor("_rank"))
    quantile = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between)
    columns = [F.max(F.when(F.col("_q") == i, quantile)).alias(name) for i, name in enumerate(names)]
    return out.groupBy(*keys).agg(*columns) if keys else out.agg(*columns)


def _within(cells: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of each wanted range, for each of the two ends."""
    both = cells.withColumn("_end", F.explode(F.array(F.lit(0), F.lit(1))))
    return attach(both, wanted, [*keys, "_q", "_end"]).where(F.col("_cell").between(F.col("_from"), F.col("_to")))


def _narrowed(cells: DataFrame, wanted: DataFrame, keys: list[str], ordered: int, parts: int) -> DataFrame:
    """Ranges with few cells: a range with more is parted, and the part that holds the wanted rank takes its place."""
    done = wanted.where(F.col("_cells") <= ordered)
    group = [*keys, "_q", "_end"]
    while True:
        wanted = wanted.where(F.col("_cells") > ordered)
        if wanted.isEmpty():
            return done
        # halves keep the width finite; infinite values are parts of their own
        share = (F.col("_cell") / 2 - F.col("_from") / 2) / (F.col("_to") / 2 - F.col("_from") / 2)
        part = F.when(F.col("_cell") == float("-inf"), -1).when(F.col("_cell") == float("inf"), parts).when(
            (F.col("_from") == float("-inf")) | (F.col("_to") == float("inf")), F.when(F.col("_cell") < 0, 0).otherwise(1)
        ).otherwise(F.least(F.floor(share * parts), F.lit(parts - 1)))
        counted = _within(cells, wanted, keys).withColumn("_part", part).groupBy(*group, "_part").agg(
            F.sum("_rows").alias("_rows"), F.count(F.lit(1)).alias("_cells"), F.min("_cell").alias("_from"),
            F.max("_cell").alias("_to"), F.first("_need").alias("_need"))
        earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        holds = (F.col("_need") >= F.col("_before")) & (F.col("_need") < F.col("_before") + F.col("_rows"))
        wanted = cut(counted.where(holds).select(*group, (F.col("_need") - F.col("_before")).alias("_need"), "_from", "_to", "_cells"))
        done = done.unionByName(wanted.where(F.col("_cells") <= ordered))


def _ranked(cells: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted value of each range; at most ``ORDERED`` cells of a range are put in order."""
    group = [*keys, "_q", "_end"]
    upto = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    ranked = _within(cells, wanted, keys).withColumn("_upto", F.sum("_rows").over(upto))
    return ranked.groupBy(*group).agg(F.min(F.when(F.col("_upto") > F.col("_need"), F.col("_cell"))).alias("_found"))
