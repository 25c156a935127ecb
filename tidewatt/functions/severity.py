"""How far a window error lies above the threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SERVED_CUTS, SIGMA_CUTS


def is_above(error: str | Column, threshold: str | Column) -> Column:
    """``error > threshold``; false, not true, for a NaN error, and null without an error or a threshold."""
    error = F.col(error) if isinstance(error, str) else error
    threshold = F.col(threshold) if isinstance(threshold, str) else threshold
    return F.when(error.isNotNull(), (error > threshold) & ~F.isnan(error))


def _levels(error: Column, threshold: Column, excess: Column, cuts: tuple[float, float]) -> Column:
    """Null where there is no error or no threshold: such a window was not scored."""
    above = is_above(error, threshold)
    return (
        F.when(above.isNull(), F.lit(None).cast("string"))
        .when(~above, "normal")
        .when(excess < F.lit(cuts[0]), "low")
        .when(excess < F.lit(cuts[1]), "medium")
        .otherwise("high")
    )


def severity_by_excess(error: Column, threshold: Column, cuts: tuple[float, float] = SERVED_CUTS) -> Column:
    """Excess as a fraction of the threshold."""
    return _levels(error, threshold, (error - threshold) / threshold, cuts)


def severity_by_sigma(
    error: Column, threshold: Column, std: Column, cuts: tuple[float, float] = SIGMA_CUTS
) -> Column:
    """Excess in standard deviations of the training errors."""
    return _levels(error, threshold, (error - threshold) / std, cuts)
