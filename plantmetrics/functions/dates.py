"""Calendar helpers: weeks end on Sunday, weekdays count from Monday = 0."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months counted as high season.
HIGH_SEASON_MONTHS = [3, 4, 5, 6, 9, 10, 11]


def week_end(day: Column) -> Column:
    """The Sunday that closes the week of ``day``."""
    return F.date_add(F.date_trunc("week", day).cast("date"), 6)


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def weekday0(day: Column) -> Column:
    return F.weekday(day)


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def season_flag(day: Column) -> Column:
    return F.month(day).isin(HIGH_SEASON_MONTHS).cast("int")


def is_business_day(day: Column) -> Column:
    return F.weekday(day) < 5


def half_open_quarter(period: str) -> tuple[dt.date, dt.date]:
    """``'2025-Q4'`` as [first day, first day of the next quarter)."""
    year, quarter = period.split("-Q")
    start = dt.date(int(year), 3 * int(quarter) - 2, 1)
    end = dt.date(start.year + 1, 1, 1) if start.month == 10 else dt.date(start.year, start.month + 3, 1)
    return start, end


def parse_period(period: Column) -> Column:
    """``'2025-Q4'`` as a struct of year, quarter and the months of the quarter."""
    year = F.split_part(period, F.lit("-"), F.lit(1)).cast("int")
    quarter = F.split_part(period, F.lit("Q"), F.lit(2)).cast("int")
    return F.struct(
        year.alias("year"),
        quarter.alias("quarter"),
        F.sequence(quarter * 3 - 2, quarter * 3).alias("months"),
    )
