"""Periods of the ledger: ranges for one moment, and starts of periods as columns."""

from __future__ import annotations

import calendar
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import DAY_MS, ms_of

PERIODS = ("Day", "Week", "Month", "Pick month", "Year", "All", "Custom")


def cycle_start(day: Column, start_day: int | Column) -> Column:
    """The start of the monthly cycle that holds a date; a start day past a month's end is its last day."""
    wanted = F.greatest(F.lit(start_day) if isinstance(start_day, int) else start_day, F.lit(1))
    on = lambda d: F.date_add(F.trunc(d, "month"), F.least(wanted, F.day(F.last_day(d))) - 1)
    this = on(day)
    return F.when(day >= this, this).otherwise(on(F.add_months(F.trunc(day, "month"), -1)))


def cycle_end(start: Column, start_day: int | Column) -> Column:
    """The start of the next cycle."""
    wanted = F.greatest(F.lit(start_day) if isinstance(start_day, int) else start_day, F.lit(1))
    following = F.add_months(F.trunc(start, "month"), 1)
    return F.date_add(following, F.least(wanted, F.day(F.last_day(following))) - 1)


def recent_months(spark: SparkSession, now: date, count: int = 12) -> DataFrame:
    """(month_ms), newest first, of the months up to now."""
    months = F.sequence(F.lit(0), F.lit(count - 1))
    start = F.trunc(F.lit(now.isoformat()).cast("date"), "month")
    return spark.range(1).select(F.explode(months).alias("back")).select("back", ms_of(F.add_months(start, -F.col("back"))).alias("month_ms"))


def _ms(day: date) -> int:
    return (day - date(1970, 1, 1)).days * DAY_MS


def _cycle_on(year: int, month: int, start_day: int) -> date:
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    return date(year, month, min(max(int(start_day), 1), calendar.monthrange(year, month)[1]))


def period_range(
    period: str, now: datetime, custom_from: date | None = None, custom_to: date | None = None, month: date | None = None, cycle_day: int = 1
) -> tuple[int | None, int | None]:
    """The half-open range of a period in wall-clock milliseconds, two literals for a scan's filter; (None, None) is all time."""
    today = now.date()

    def cycle(start: date) -> tuple[int, int]:
        return _ms(start), _ms(_cycle_on(start.year, start.month + 1, cycle_day))

    def around() -> tuple[int, int]:
        this = _cycle_on(today.year, today.month, cycle_day)
        return cycle(this if today >= this else _cycle_on(today.year, today.month - 1, cycle_day))

    if period == "Day":
        return _ms(today), _ms(today) + DAY_MS
    if period == "Week":
        monday = _ms(today - timedelta(days=today.weekday()))
        return monday, monday + 7 * DAY_MS
    if period == "Month" or period == "Pick month" and month is None:
        return around()
    if period == "Pick month":
        return cycle(_cycle_on(month.year, month.month, cycle_day))
    if period == "Year":
        return _ms(date(today.year, 1, 1)), _ms(date(today.year + 1, 1, 1))
    if period == "Custom":
        if custom_from is None or custom_to is None:
            return _ms(today) + DAY_MS - 30 * DAY_MS, _ms(today) + DAY_MS
        first, last = sorted((custom_from, custom_to))
        return _ms(first), _ms(last) + DAY_MS
    return None, None
