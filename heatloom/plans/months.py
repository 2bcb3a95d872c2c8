"""Flows over months and forecast runs: raw weather to a stored harmonised table, and from there to stored predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import forecast_hours, issue_time, to_time, year_month
from ..operators.tables import within_bbox
from ..sources.store import PART, commit, current_parts, read_store
from ..sources.tables import exists, missing_months, month_range, write_predictions
from .harmonise import forecast_weather, history_weather

# Rows of a station that depend on the month before or after: its last one
# (means with the next hour), and its first two (rain falls back on the row before).
LAST_ROWS, FIRST_ROWS = 1, 2
MARKS = "ym int, version string"


def _runs(missing: Sequence[int], there: Sequence[int], most: int) -> list[tuple[list[int], int | None, int | None]]:
    """Missing months in runs of neighbours in ``there``, each with the months before and after it."""
    place = {ym: i for i, ym in enumerate(there)}
    runs: list[list[int]] = []
    for ym in missing:
        if runs and len(runs[-1]) < most and place[runs[-1][-1]] == place[ym] - 1:
            runs[-1].append(ym)
        else:
            runs.append([ym])
    at = dict(enumerate(there))
    return [(run, at.get(place[run[0]] - 1), at.get(place[run[-1]] + 1)) for run in runs]


def fill_months(
    raw: DataFrame, root: str, first: int, last: int, box: Sequence[float] | None = None, months_per_commit: int = 12,
    time: str = "valid_time", harmonise: Callable[[DataFrame], DataFrame] = history_weather,
) -> list[int]:
    """Harmonises the months ``first..last`` (yyyymm) that ``raw`` holds and the store at ``root`` lacks; returns those months.

    Months are computed together with the ones before and after them and committed up to ``months_per_commit`` at a time, each commit
    whole or not at all: a rerun after a failure goes on with what is missing, and one
    without new months changes nothing. The edge rows of stored months that get a new neighbour are
    merged in again. So months that come in any order, also late into a hole, give what one pass over everything gives, for stations
    with at least four rows in each month. A month of which no row is left after
    harmonising is not stored and is tried again. ``raw`` has one row for each place and time; rows without a time belong to no month. ``box`` is as in :func:`within_bbox`.
    """
    spark = raw.sparkSession
    if box is not None:
        raw = within_bbox(raw, "latitude", "longitude", box)
    dated = raw.withColumn("_ym", year_month(to_time(F.col(time))))
    # Lists of months, a few for each year.
    there = sorted(r["_ym"] for r in dated.select("_ym").where("_ym IS NOT NULL").distinct().collect())
    stored = current_parts(spark, root).select(F.col(PART).try_cast("int").alias("ym"))
    have = {r["ym"] for r in stored.collect()}
    missing = missing_months(month_range(spark, first, last).where(F.col("ym").isin(there)), stored)
    todo = sorted(r["ym"] for r in missing.collect())
    for run, before, after in _runs(todo, there, months_per_commit):
        context = dated.where(F.col("_ym").isin([*run, *(m for m in (before, after) if m is not None)])).drop("_ym")
        ym = year_month(F.col("time"))
        of_month = Window.partitionBy("weatherStation", ym)
        out = harmonise(context).withColumns({"_row": F.row_number().over(of_month.orderBy("time")), "_rows": F.count("*").over(of_month)})
        keep = ym.isin(run)
        if before in have:
            keep = keep | (ym == before) & (F.col("_row") > F.col("_rows") - LAST_ROWS)
        if after in have:
            keep = keep | (ym == after) & (F.col("_row") <= FIRST_ROWS)
        commit(out.where(keep).drop("_row", "_rows"), root, ["weatherStation", "time"], ["time"], ym)
        have |= set(run)
    return todo


def read_filled(spark: SparkSession, root: str, first: int, last: int) -> DataFrame:
    """The stored harmonised rows of some months; only their files are opened."""
    months = [str(r["ym"]) for r in month_range(spark, first, last).collect()]
    return read_store(spark, root, months)


def predict_months(
    spark: SparkSession, weather: str, root: str, first: int, last: int, score: Callable[[DataFrame], DataFrame],
    months_per_write: int = 12,
) -> list[int]:
    """Predicts each month of the store ``weather`` that has none yet, or that changed since; returns those months.

    ``score`` takes harmonised rows of some months and returns predictions with ``time`` (:func:`predict_grid` with all but its rows bound).
    Up to ``months_per_write`` months are predicted together; they replace what was there, and then their versions are
    noted, so a run that fails in between only does these months again.
    """
    noted = f"{root}_months"
    done = spark.read.schema(MARKS).json(noted) if exists(spark, noted) else spark.createDataFrame([], MARKS)
    stored = current_parts(spark, weather).select(F.col(PART).try_cast("int").alias("ym"), "version")
    todo = stored.where(F.col("ym").between(first, last)).join(done, ["ym", "version"], "left_anti").orderBy("ym").collect()
    for i in range(0, len(todo), months_per_write):
        some = todo[i : i + months_per_write]
        write_predictions(score(read_store(spark, weather, [str(m["ym"]) for m in some])), root)
        spark.createDataFrame([tuple(m) for m in some], MARKS).write.mode("append").json(noted)
    return [month["ym"] for month in todo]


def forecast_rows(
    raw: DataFrame, today: str, nd: int = 3, box: Sequence[float] | None = None, issued: str = "issued", **options,
) -> DataFrame:
    """Harmonised rows of the runs issued today and on the ``nd`` days before, keyed by ``forecastingTime``, time and station.

    ``raw`` holds the forecast rows of all runs, told apart by the timestamp ``issued``; each run is
    harmonised by itself, so its rows never meet those of another run, and cut to its 96 hours. A run that was issued several times
    in a day must be reduced before.
    """
    day = F.date_trunc("day", F.lit(today).cast("timestamp_ntz"))
    of = F.date_trunc("day", F.col(issued)).cast("timestamp_ntz")
    recent = raw.where((of >= day - F.expr(f"INTERVAL {nd} DAY")) & (of <= day))
    if box is not None:
        recent = within_bbox(recent, "lat", "lon", box)
    start = issue_time(of).cast("timestamp_ntz")
    keyed = recent.withColumn("forecastingTime", start).drop(issued)
    rows = forecast_weather(keyed, batch_col="forecastingTime", **options)
    hours = F.transform(forecast_hours(F.col("forecastingTime")), lambda h: h.cast("timestamp_ntz"))
    hour = F.date_trunc("hour", F.col("time")).cast("timestamp_ntz")
    return rows.where(hour.between(F.array_min(hours), F.array_max(hours)))


def write_forecast(predictions: DataFrame, root: str, today: str) -> None:
    """The predictions as they stood on one day, in a folder ``predicted=<day>`` that is replaced alone."""
    day = F.date_format(F.lit(today).cast("timestamp_ntz"), "yyyy-MM-dd")
    (
        predictions.withColumn("predicted", day).hint("rebalance")
        .write.partitionBy("predicted").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)
    )
