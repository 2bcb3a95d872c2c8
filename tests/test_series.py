"""Hand-made series: ends, batches, ragged stations, repairs, long series."""

import datetime as dt

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from heatloom.operators import series
from heatloom.operators.neighbours import HOUR, with_neighbours

T0 = dt.datetime(2020, 1, 31, 20)


def hours(n, start=T0):
    return [start + dt.timedelta(hours=i) for i in range(n)]


def table(spark, data, cols="weatherStation string, time timestamp_ntz, v double"):
    return spark.createDataFrame(data, cols)


def test_interval_mean_is_per_station(spark):
    data = [("A", t, float(i)) for i, t in enumerate(hours(4))] + [("B", t, 10.0 * i) for i, t in enumerate(hours(3))]
    got = rows(series.interval_mean(table(spark, data), ["v"]), "weatherStation", "v")
    assert got == [("A", 0.5), ("A", 1.5), ("A", 2.5), ("A", 3.0), ("B", 15.0), ("B", 20.0), ("B", 5.0)]


def test_interval_mean_batch_edge(spark):
    data = [("A", t, float(i)) for i, t in enumerate(hours(6))]
    df = table(spark, data).withColumn("ym", F.expr("year(time) * 100 + month(time)"))
    whole = {r["time"]: r["v"] for r in series.interval_mean(df, ["v"]).collect()}
    monthly = {r["time"]: r["v"] for r in series.interval_mean(df, ["v"], batch_col="ym").collect()}
    edge = dt.datetime(2020, 1, 31, 23)
    assert whole[edge] == 3.5 and monthly[edge] == 3.0
    assert {t: x for t, x in whole.items() if t != edge} == {t: x for t, x in monthly.items() if t != edge}


def test_interval_mean_circular(spark):
    df = table(spark, [("A", t, x) for t, x in zip(hours(2), (350.0, 20.0))])
    assert rows(series.interval_mean(df, ["v"]), "v")[0] == (185.0,)
    got = [r[0] for r in rows(series.interval_mean(df, ["v"], circular=["v"]), "v")]
    assert min(got) == pytest.approx(5.0)


def test_rain_reset_and_last_row(spark):
    df = table(spark, [("A", t, x) for t, x in zip(hours(3), (0.001, 0.002, 0.0005))])
    got = [r["v"] for r in series.deaccumulate_rain(df, "v").orderBy("time").collect()]
    assert got == pytest.approx([0.0, 0.0, -1.5])
    fixed = [r["v"] for r in series.deaccumulate_rain(df, "v", fix_last_unit=True).orderBy("time").collect()]
    assert fixed == pytest.approx([0.0, 0.0, -1.5])


def test_rain_last_row_has_no_factor(spark):
    df = table(spark, [("A", t, x) for t, x in zip(hours(3), (0.001, 0.002, 0.004))])
    got = [r["v"] for r in series.deaccumulate_rain(df, "v").orderBy("time").collect()]
    assert got == pytest.approx([0.0, 2.0, 0.002])
    fixed = [r["v"] for r in series.deaccumulate_rain(df, "v", fix_last_unit=True).orderBy("time").collect()]
    assert fixed == pytest.approx([0.0, 2.0, 2.0])


def test_radiation_ends_and_negative(spark):
    df = table(spark, [("A", t, x) for t, x in zip(hours(5), (0.0, 3600.0, 7200.0, 0.0, 36000.0))])
    got = [r["v"] for r in series.deaccumulate_radiation(df, "v").orderBy("time").collect()]
    assert got == pytest.approx([0.0, 1.0, 0.0, 10.0, 0.0])


def test_single_row_series(spark):
    df = table(spark, [("A", T0, 5.0)])
    assert rows(series.interval_mean(df, ["v"]), "v") == [(5.0,)]
    assert rows(series.deaccumulate_rain(df, "v"), "v") == [(0.0,)]


def test_rolling_min_skips_nulls(spark):
    df = table(spark, [("A", t, x) for t, x in zip(hours(4), (34.0, None, 36.0, 31.0))])
    got = [r["low"] for r in series.rolling_min(df, "v", 3, alias="low").orderBy("time").collect()]
    assert got == [34.0, 34.0, 34.0, 31.0]


def test_densify_marks_holes(spark):
    df = table(spark, [("A", T0, 1.0), ("B", T0 + dt.timedelta(days=2), 2.0)])
    got = rows(series.densify(df), "weatherStation", "v")
    assert got == [("A", 1.0), ("A", None), ("B", 2.0), ("B", None)]


def test_densify_visits_only_days_that_occur(spark):
    df = table(spark, [("A", dt.datetime(1900, 1, 1), 1.0), ("B", dt.datetime(2024, 5, 5), 2.0)])
    got = series.densify(df)
    assert got.count() == 4
    assert "sequence" not in got._jdf.queryExecution().optimizedPlan().toString()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("ABC"), st.integers(0, 40_000_000)), min_size=1, max_size=60, unique=True),
    st.sampled_from([HOUR, 24 * HOUR, 7 * 24 * HOUR]),
)
def test_neighbours_equal_plain_window(spark, points, width):
    base = dt.datetime(2000, 1, 1)
    df = table(spark, [(k, base + dt.timedelta(seconds=s * 7), float(s)) for k, s in points])
    w = Window.partitionBy("weatherStation").orderBy("time")
    plain = df.select("weatherStation", "time", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"),
                      F.min("time").over(Window.partitionBy("weatherStation")).alias("a"))
    got = with_neighbours(df, ["weatherStation"], "time", ["v"], bucket_seconds=width).select(
        "weatherStation", "time", F.col("_prev_v").alias("p"), F.col("_next_v").alias("n"), F.col("_first_time").alias("a"))
    assert rows(got) == rows(plain)


def test_equal_times_are_ordered_by_tie(spark):
    df = spark.createDataFrame([("A", T0, i, float(i * i)) for i in range(6)], "weatherStation string, time timestamp_ntz, id int, v double")
    for width in (HOUR, 7 * 24 * HOUR):
        got = series.deaccumulate_rain(df, "v", tie=["id"], fix_last_unit=True, bucket_seconds=width).orderBy("id").collect()
        assert [r["v"] for r in got] == [0.0, 3000.0, 5000.0, 7000.0, 9000.0, 9000.0]


def test_long_series_are_cut_by_bucket(spark, data):
    """Row windows are cut by bucket; bucket ends shrink before their shuffle."""
    df = spark.read.parquet(f"{data}/events.parquet").selectExpr(
        "concat('s', user_id % 3) AS weatherStation", "ts AS time", "value AS v", "event_id"
    )
    plan = series.interval_mean(df, ["v"], bucket_seconds=HOUR)._jdf.queryExecution().executedPlan().toString()
    row_windows = [line for line in plan.splitlines() if "Window [lead(time" in line]
    assert row_windows and all("_b#" in line.split("windowspecdefinition(")[1].split("ASC")[0] for line in row_windows)
    assert "partial_min_by(v" in plan and "HashAggregate(keys=[weatherStation" in plan
    ends_scan = [line for line in plan.splitlines() if "FileScan" in line][-1]
    assert "event_id" not in ends_scan
