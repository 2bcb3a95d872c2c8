"""Hours, dates, Fourier terms and issue times."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The hours counted as day; all other hours are night.
DAY_FIRST_HOUR = 9
DAY_LAST_HOUR = 20
# A forecast run starts at 01:00 and spans 96 hours.
ISSUE_HOUR = 1
FORECAST_DAYS = 4


def is_day(time: Column) -> Column:
    return F.hour(time).between(DAY_FIRST_HOUR, DAY_LAST_HOUR)


def is_night(time: Column) -> Column:
    return ~is_day(time)


def time_parts(df: DataFrame, time: str = "time") -> DataFrame:
    t = F.col(time)
    return df.withColumns(
        {"hour": F.hour(t), "month": F.month(t), "date": F.to_date(t), "year": F.year(t)}
    )


def year_month(time: Column) -> Column:
    return (F.year(time) * 100 + F.month(time)).cast("int")


def fourier_columns(c: Column, name: str, period: int, n: int) -> dict[str, Column]:
    """``name_h_sin`` and ``name_h_cos`` for harmonics 1..n."""
    out: dict[str, Column] = {}
    for h in range(1, n + 1):
        angle = c * F.lit(2 * math.pi * h) / F.lit(float(period))
        out[f"{name}_{h}_sin"] = F.sin(angle)
        out[f"{name}_{h}_cos"] = F.cos(angle)
    return out


def fourier(df: DataFrame, time: str = "time", n: int = 4) -> DataFrame:
    """Hour-of-day and month-of-year harmonics of a time column."""
    t = F.col(time)
    return df.withColumns(
        fourier_columns(F.hour(t), "hour", 24, n) | fourier_columns(F.month(t), "month", 12, n)
    )


def issue_time(c: Column) -> Column:
    return F.date_trunc("day", c) + F.expr(f"INTERVAL {ISSUE_HOUR} HOUR")


def forecast_hours(issue: Column) -> Column:
    """Array of the hours a run covers, 01:00 of day 0 to 00:00 of day 4."""
    start = issue_time(issue)
    end = F.date_trunc("day", issue) + F.expr(f"INTERVAL {FORECAST_DAYS} DAY")
    return F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))


def to_time(c: Column) -> Column:
    """Text or timestamp to a zone-less timestamp; unreadable text is null."""
    return c.try_cast("timestamp_ntz")
