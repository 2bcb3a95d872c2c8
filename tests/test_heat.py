import datetime as dt

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from heatloom.operators import heat
from heatloom.plans import indicators

DAY = dt.datetime(2022, 7, 1)


def weather(spark, data):
    return spark.createDataFrame(data, "weatherStation string, time timestamp_ntz, airTemperature double, relativeHumidity double")


def flat(tdb, rh):
    return tdb + rh * 0.0


def test_lookup_size_and_corners(spark):
    lk = heat.build_lookup(spark)
    assert lk.count() == 81 * 101
    assert lk.agg(F.min("tdb"), F.max("tdb"), F.min("rh"), F.max("rh")).first() == (-20, 60, 0, 100)


def test_heat_index_published_value(spark):
    # 90 F at 70 % is listed as 106 F.
    got = heat.build_lookup(spark, tdb=(32, 33)).where("rh = 70 AND tdb = 32").first()["heat_index"]
    assert got * 1.8 + 32 == pytest.approx(105, abs=1.5)


def test_bilinear_matches_formula_and_extrapolates(spark):
    lk = heat.build_lookup(spark, lambda t, h: t * 2 + h * 3 + t * h)
    points = [(-30.0, -5.0), (70.0, 110.0), (0.25, 50.5), (-20.0, 0.0), (60.0, 100.0), (33.333, 99.99)]
    df = spark.createDataFrame(points, "x double, y double")
    got = heat.bilinear(df, F.col("x"), F.col("y"), lk, "z")
    for r in got.collect():
        assert r["z"] == pytest.approx(2 * r["x"] + 3 * r["y"] + r["x"] * r["y"])


def test_bilinear_keeps_rows_without_input(spark):
    df = spark.createDataFrame([(None, 5.0), (float("nan"), 5.0), (1.0, 5.0)], "x double, y double")
    got = heat.bilinear(df, F.col("x"), F.col("y"), heat.build_lookup(spark, flat), "z")
    assert sorted((r["z"] for r in got.collect()), key=repr) == [1.0, None, None]


def test_lookup_join_is_broadcast(spark):
    df = spark.range(5).selectExpr("CAST(id AS DOUBLE) AS x", "1D AS y")
    plan = heat.bilinear(df, F.col("x"), F.col("y"), heat.build_lookup(spark), "z")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_one_sided_day_keeps_keys(spark):
    df = weather(spark, [("A", DAY.replace(hour=12), 30.0, 0.5)])
    r = heat.daily_stats(df, "airTemperature").first()
    assert (r["weatherStation"], r["day_temp_max"], r["night_temp_max"]) == ("A", 30.0, None)


def test_night_and_day_hours(spark):
    df = weather(spark, [("A", DAY.replace(hour=h), float(h), 0.5) for h in range(24)])
    r = heat.daily_stats(df, "airTemperature").first()
    assert (r["day_temp_min"], r["day_temp_max"]) == (9.0, 20.0)
    assert (r["night_temp_min"], r["night_temp_max"]) == (0.0, 23.0)
    assert r["night_temp_mean"] == pytest.approx(np.mean([*range(9), 21, 22, 23]))


def daily(spark, values):
    data = [("A", (DAY + dt.timedelta(days=i)).date(), *v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "weatherStation string, date date, night_temp_min double, day_temp_max double, day_temp_mean double")


def test_flags_at_their_limits(spark):
    limits = [26.9, 27.0, 33.0, 41.0, 52.0, 92.0]
    names = ["safe", "caution", "extremeCaution", "hazardous", "extremeHazardous", "beyondHumanLimit"]
    got = heat.heat_flags(daily(spark, [(20.0, x, x) for x in limits])).orderBy("date").collect()
    for r, name in zip(got, names):
        hit = [n for n in names if r[f"{n}MaxTemperature"]]
        assert hit == [name] and r[f"{name}AverageTemperature"]
        assert r["tropicalNight"] is False


def test_heat_wave_rolls_over_rows(spark):
    got = heat.heat_flags(daily(spark, [(21.0, x, 30.0) for x in (34.0, 35.0, 36.0, 33.0, 40.0)])).orderBy("date").collect()
    assert [r["heatWave"] for r in got] == [True, True, True, False, False]


def test_null_flags_count_zero(spark):
    counts = heat.yearly_counts(heat.heat_flags(daily(spark, [(None, None, None)]))).first()
    assert all(counts[n] == 0 for n in heat.FLAG_NAMES)


def test_nan_is_not_hot(spark):
    df = weather(spark, [("A", DAY.replace(hour=12), float("nan"), 0.5)])
    counts = indicators.yearly_heat(df, heat.build_lookup(spark, flat)).first()
    assert all(counts[n] == 0 for n in heat.FLAG_NAMES)


def test_two_locations_at_one_station(spark):
    df = weather(spark, [("41.4_2.1", DAY.replace(hour=12), 30.0, 0.5), ("41.9_2.9", DAY.replace(hour=12), 10.0, 0.5)])
    loc = spark.createDataFrame([("one", 41.41, 2.11), ("two", 41.39, 2.09)], "name string, lat double, lon double")
    got = rows(heat.location_series(df, loc, heat.build_lookup(spark, flat)), "locationName", "heatIndex")
    assert got == [("one", 30.0), ("two", 30.0)]


def test_january_slice_reads_december(spark):
    data = [("41.4_2.1", 202112, 1), ("41.4_2.1", 202201, 2), ("41.4_2.1", 202111, 3), ("41.4_2.1", 202101, 4)]
    df = spark.createDataFrame(data, "weatherStation string, ym int, v int")
    got = heat.slice_for_map(df, "2022-01-15 05:00:00")
    assert rows(got, "v", "latitude", "longitude") == [(1, 41.4, 2.1), (2, 41.4, 2.1)]


def test_degree_days(spark):
    df = weather(spark, [("A", DAY + dt.timedelta(hours=h), 10.0 if h < 24 else 25.0, 0.5) for h in range(48)])
    assert rows(heat.degree_days(df), "HDD", "CDD") == [(8.0, 4.0)]
