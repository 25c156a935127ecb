"""Calendar columns: parts, flags, cyclic encodings, names, holidays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DAY_NAMES, TIME

# --- fixed values -----------------------------------------------------------
# Public holidays of Panama ("PA"): month, day, name.
FIXED_HOLIDAYS = {
    "PA": [
        (1, 1, "New Year's Day"),
        (1, 9, "Martyrs' Day"),
        (5, 1, "Labour Day"),
        (11, 3, "Separation Day"),
        (11, 4, "National Symbols Day"),
        (11, 5, "Colon Day"),
        (11, 10, "Los Santos Uprising Day"),
        (11, 28, "Independence Day"),
        (12, 8, "Mothers' Day"),
        (12, 25, "Christmas Day"),
    ],
}
# Days counted from Easter Sunday: offset, name.
EASTER_HOLIDAYS = {"PA": [(-47, "Carnival"), (-2, "Good Friday")]}
CYCLES = {"hour": 24, "dayofweek": 7, "month": 12}
# --- end of fixed values ----------------------------------------------------


def calendar_parts(time: str | Column = TIME) -> dict[str, Column]:
    """hour, day_of_week (Monday = 0), month, day, year."""
    return {
        "hour": F.hour(time),
        "day_of_week": F.weekday(time),
        "month": F.month(time),
        "day": F.dayofmonth(time),
        "year": F.year(time),
    }


def weekend_flag(time: str | Column = TIME) -> Column:
    return (F.weekday(time) >= 5).cast("int")


def cyclic_encoding(time: str = TIME) -> dict[str, Column]:
    """The six sin/cos columns. Months run from 1 to 12 and are not shifted."""
    parts = {"hour": "hour", "dayofweek": "weekday", "month": "month"}
    return {
        f"{name}_{wave}": F.expr(f"{wave}({2 * math.pi!r}D * {parts[name]}(`{time}`) / {period})")
        for name, period in CYCLES.items() for wave in ("sin", "cos")
    }


def weekday_name(day: str | Column = "day_of_week") -> Column:
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    return F.element_at(names, (F.col(day) if isinstance(day, str) else day) + F.lit(1))


def time_text(time: str | Column) -> Column:
    """ISO-8601 without a zone."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def step_label(step: str | Column, time: str | Column | None = None) -> Column:
    """ISO time of a forecast step, or ``T+{n}h`` where there is no time axis."""
    relative = F.concat(F.lit("T+"), (F.col(step) if isinstance(step, str) else step).cast("string"), F.lit("h"))
    return relative if time is None else F.coalesce(time_text(time), relative)


# Easter Sunday by the Gregorian computus (Meeus/Jones/Butcher), one step a line.
_EASTER_STEPS = [
    "cast(id AS INT) AS year", "year % 19 AS golden", "year div 100 AS century", "year % 100 AS rest",
    "(century - (century + 8) div 25 + 1) div 3 AS leap",
    "(golden * 19 + century - century div 4 - leap + 15) % 30 AS epact",
    "(32 + (century % 4) * 2 + (rest div 4) * 2 - epact - rest % 4) % 7 AS weekday",
    "(golden + epact * 11 + weekday * 22) div 451 AS late",
    "epact + weekday - late * 7 + 114 AS days",
    "make_date(year, cast(days div 31 AS INT), cast(days % 31 + 1 AS INT)) AS easter",
]


def holiday_table(
    spark: SparkSession, first_year: int, last_year: int, country: str = "PA",
    observed: bool = True,
) -> DataFrame:
    """(country, date, name), built from the rules for a range of years.

    With ``observed`` a holiday on a Sunday is also kept on the Monday after.
    """
    def entry(date: str, name: str) -> str:
        return f"struct({date} AS date, '{name.replace(chr(39), chr(92) + chr(39))}' AS name)"

    entries = [entry(f"make_date(year, {m}, {d})", name) for m, d, name in FIXED_HOLIDAYS[country]]
    entries += [entry(f"date_add(easter, {off})", name) for off, name in EASTER_HOLIDAYS[country]]
    years = spark.range(first_year, last_year + 1).selectExpr(*_EASTER_STEPS)
    days = years.selectExpr(f"inline(array({', '.join(entries)}))")
    if observed:
        days = days.selectExpr(
            "inline(if(weekday(date) = 6, array(struct(date, name), "
            "struct(date_add(date, 1) AS date, concat(name, ' (observed)') AS name)), array(struct(date, name))))")
    return days.select(F.lit(country).alias("country"), "date", "name")


def holiday_flag(df: DataFrame, holidays: DataFrame, time: str = TIME, name: str = "is_holiday") -> DataFrame:
    """0/1 flag from a holiday table; adaptive execution sizes the join side."""
    dates = holidays.select(F.col("date").alias("_date")).distinct().withColumn(name, F.lit(1))
    return (
        df.join(dates, F.to_date(time) == F.col("_date"), "left").drop("_date")
        .withColumn(name, F.coalesce(name, F.lit(0)))
    )


def on_holidays(df: DataFrame, holidays: DataFrame, time: str = TIME) -> DataFrame:
    """Only the rows that fall on a holiday."""
    dates = holidays.select(F.col("date").alias("_date"))
    return df.join(dates, F.to_date(time) == F.col("_date"), "left_semi")
