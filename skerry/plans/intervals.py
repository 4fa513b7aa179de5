"""Harvest intervals and resume points as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"month": "MONTH", "day": "DAY", "hour": "HOUR"}


def intervals(spans: DataFrame, unit: str, begin: str = "begin", end: str = "end") -> DataFrame:
    """A row for each interval of a span, with from_ts and until_ts (its last microsecond).

    Months are clipped at both ends. Days and hours are whole, so the last may end behind the span.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    step = F.expr(f"INTERVAL 1 {UNITS[unit]}")
    b, e = F.col(begin), F.col(end)
    first = F.date_trunc(UNITS[unit], b)
    start = F.when(first <= e, F.sequence(first, e, step)).otherwise(F.array().cast("array<timestamp>"))
    exploded = spans.withColumn("_at", F.explode(start))
    at, last = F.col("_at"), F.col("_at") + step - F.expr("INTERVAL 1 MICROSECOND")
    if unit == "month":
        return exploded.select(*spans.columns, F.greatest(at, b).alias("from_ts"), F.least(last, e).alias("until_ts"))
    return exploded.select(*spans.columns, at.alias("from_ts"), last.alias("until_ts"))


def resume_from(last_date: Column, earliest: Column) -> Column:
    """The day after the last file's date; the earliest date itself if nothing is there yet."""
    return F.when(last_date.isNull() | (last_date == earliest), earliest).otherwise(F.date_format(F.date_add(F.to_date(last_date), 1), "yyyy-MM-dd"))


def upper_bound(until: Column, today: Column) -> Column:
    """``until``, or yesterday."""
    return F.coalesce(F.nullif(until, F.lit("")), F.date_format(F.date_sub(today, 1), "yyyy-MM-dd"))


def plan(harvests: DataFrame, today: Column) -> DataFrame:
    """harvests (last_date, earliest, until) with from_date, until_date and synced (nothing is left to fetch)."""
    found = harvests.withColumn("from_date", resume_from(F.col("last_date"), F.col("earliest"))).withColumn("until_date", upper_bound(F.col("until"), today))
    return found.withColumn("synced", F.coalesce(F.col("last_date") >= F.col("until_date"), F.lit(False)))
