"""Time-series steps on weather tables: interval means and de-accumulation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import drop_neighbours, with_neighbours

# Radiation arrives as J/m2 per hour, rain in metres.
SECONDS_PER_HOUR = 3600
MM_PER_METRE = 1000


def _series_keys(keys: Sequence[str], batch_col: str | None) -> list[str]:
    """With a batch column each batch is its own series, so its first and last
    rows get the edge rules; without it the series is continuous."""
    return [*keys, batch_col] if batch_col else list(keys)


def interval_mean_expr(v: str, time: str = "time", circular: bool = False) -> Column:
    here, after = F.col(v), F.col(f"_next_{v}")
    if circular:
        a, b = F.radians(here), F.radians(after)
        mean = F.pmod(F.degrees(F.atan2(F.sin(a) + F.sin(b), F.cos(a) + F.cos(b))), F.lit(360.0))
    else:
        mean = (after + here) / F.lit(2.0)
    return F.when(F.col(f"_next_{time}").isNotNull(), mean).otherwise(here)


def interval_mean(
    df: DataFrame,
    variables: Sequence[str],
    keys: Sequence[str] = ("weatherStation",),
    time: str = "time",
    tie: Sequence[str] = (),
    batch_col: str | None = None,
    circular: Sequence[str] = (),
    **cut: int,
) -> DataFrame:
    """Each value becomes the mean of itself and the next one; the last stays.

    Directions named in ``circular`` are averaged as vectors. ``cut`` are the
    options of :func:`with_neighbours` for long series.
    """
    n = with_neighbours(df, _series_keys(keys, batch_col), time, variables, tie, **cut)
    return drop_neighbours(n.withColumns({v: interval_mean_expr(v, time, v in circular) for v in variables}))


def radiation_expr(v: str, time: str = "time") -> Column:
    """Hourly mean flux from an accumulated sum; 0 at the ends and where not > 0."""
    flux = (F.col(f"_next_{v}") - F.col(v)) / F.lit(float(SECONDS_PER_HOUR))
    inner = F.col(f"_prev_{time}").isNotNull() & F.col(f"_next_{time}").isNotNull()
    return F.when(inner & (flux > 0), flux).otherwise(F.lit(0.0))


def rain_expr(v: str, time: str = "time", tie: Sequence[str] = (), fix_last_unit: bool = False) -> Column:
    """Hourly rain from an accumulated sum.

    First row 0, last row the difference to the row before (in metres unless
    ``fix_last_unit``), else the difference to the next row in mm. A negative
    result takes the unrepaired result of the row before.
    """
    here, prev, after = F.col(v), F.col(f"_prev_{v}"), F.col(f"_next_{v}")
    is_first, is_last = F.col(f"_prev_{time}").isNull(), F.col(f"_next_{time}").isNull()
    mm = F.lit(float(MM_PER_METRE))
    last = (here - prev) * mm if fix_last_unit else here - prev
    raw = F.when(is_first, F.lit(0.0)).when(is_last, last).otherwise((after - here) * mm)
    prev_is_first = F.lit(True)
    for c in (time, *tie):
        prev_is_first = prev_is_first & (F.col(f"_prev_{c}") == F.col(f"_first_{c}"))
    before = F.when(prev_is_first, F.lit(0.0)).otherwise((here - prev) * mm)
    return F.when(raw >= 0, raw).when(~is_first, before)


def deaccumulate_radiation(df: DataFrame, col: str = "GHI", keys: Sequence[str] = ("weatherStation",),
                           time: str = "time", tie: Sequence[str] = (), batch_col: str | None = None,
                           **cut: int) -> DataFrame:
    n = with_neighbours(df, _series_keys(keys, batch_col), time, [col], tie, **cut)
    return drop_neighbours(n.withColumn(col, radiation_expr(col, time)))


def deaccumulate_rain(df: DataFrame, col: str = "totalPrecipitation", keys: Sequence[str] = ("weatherStation",),
                      time: str = "time", tie: Sequence[str] = (), batch_col: str | None = None,
                      fix_last_unit: bool = False, **cut: int) -> DataFrame:
    n = with_neighbours(df, _series_keys(keys, batch_col), time, [col], tie, **cut)
    return drop_neighbours(n.withColumn(col, rain_expr(col, time, tie, fix_last_unit)))


def harmonise_series(
    df: DataFrame,
    mean_of: Sequence[str],
    keys: Sequence[str],
    time: str = "time",
    radiation: str | None = None,
    rain: str | None = None,
    batch_col: str | None = None,
    circular: Sequence[str] = (),
    fix_last_unit: bool = False,
    **cut: int,
) -> DataFrame:
    """Interval means and both de-accumulations after a single shuffle."""
    cols = [*mean_of, *([radiation] if radiation else []), *([rain] if rain else [])]
    n = with_neighbours(df, _series_keys(keys, batch_col), time, cols, (), **cut)
    new = {v: interval_mean_expr(v, time, v in circular) for v in mean_of}
    if radiation:
        new[radiation] = radiation_expr(radiation, time)
    if rain:
        new[rain] = rain_expr(rain, time, (), fix_last_unit)
    return drop_neighbours(n.withColumns(new))


def rolling_min(df: DataFrame, col: str, n: int = 3, keys: Sequence[str] = ("weatherStation",),
                time: str = "time", alias: str | None = None) -> DataFrame:
    """Minimum of this and the ``n - 1`` rows before; nulls are skipped.

    For daily tables: with one row per station and date a series holds at most
    one row per calendar day, so it fits a task at any number of stations.
    """
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(-(n - 1), 0)
    return df.withColumn(alias or f"rolling_min_{col}", F.min(col).over(w))


def nearest_time(df: DataFrame, moment: str, time: str = "time") -> DataFrame:
    """All rows whose time is nearest to ``moment``; of two equally near times
    the earlier. The nearest time is a partial aggregate, then a filter."""
    t = F.lit(moment).cast("timestamp")
    gap = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(t))
    nearest = df.select(time).agg(F.min(F.struct(gap.alias("gap"), F.col(time).alias("t"))).alias("m")).select("m.t")
    return df.where(F.col(time) == nearest.scalar())


def densify(df: DataFrame, time: str = "time", station: str = "weatherStation") -> DataFrame:
    """Every observed time for every observed station; holes become null rows.

    Stations are spread over the days that occur and meet the times of that day
    by an equi-join, so work is split by day.
    """
    day = F.to_date(time)
    times = df.select(time).distinct().withColumn("_day", day)
    days = df.agg(F.collect_set(day).alias("days")).scalar()
    station_days = df.select(station).distinct().select(station, F.explode(days).alias("_day"))
    frame = station_days.join(times, "_day").select(time, station)
    return frame.join(df, [time, station], "left")
