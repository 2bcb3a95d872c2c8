"""Weather-like views over the given tables, for Spark and for DuckDB.

Both sides use the same arithmetic; none of the views shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Hourly-like weather of four stations.
WX = """wx AS (
  SELECT event_id, ts AS time,
         concat('41.', 31 + user_id % 4, '_2.', 11 + user_id % 4) AS weatherStation,
         14.0::double + 1.5::double * (day(ts) % 12) + user_id % 4
           + CASE WHEN hour(ts) BETWEEN 9 AND 20 THEN 5.0::double ELSE 0.0::double END + value % 3 AS airTemperature,
         CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS relativeHumidity
  FROM events)"""


def wx(spark: SparkSession, d: str) -> DataFrame:
    return wx_of(table(spark, d, "events"))


def wx_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id", "ts AS time",
        "concat('41.', 31 + user_id % 4, '_2.', 11 + user_id % 4) AS weatherStation",
        "14.0D + 1.5D * (day(ts) % 12) + user_id % 4"
        " + CASE WHEN hour(ts) BETWEEN 9 AND 20 THEN 5.0D ELSE 0.0D END + value % 3 AS airTemperature",
        "CAST(get_json_object(props, '$.k') AS DOUBLE) / 100 AS relativeHumidity",
    )


# Raw history rows on a 5 x 6 grid.
RAW = """raw AS (
  SELECT event_id, ts AS valid_time, round(41.2::double + 0.1::double * (user_id % 5), 1) AS latitude,
         round(1.9::double + 0.1::double * ((user_id // 5) % 6), 1) AS longitude,
         value % 7 - 3 AS u10, value % 5 - 2 AS v10, 273.15::double + value % 40 AS t2m,
         273.15::double + value % 40 - CAST(json_extract(props, '$.k') AS DOUBLE) % 20 AS d2m,
         value % 2 AS lai_lv, value % 3 AS lai_hv, (event_id % 7) * 0.001::double AS tp,
         (event_id % 11) * 360000.0::double AS ssrd, 0.1::double + value % 1 / 10 AS fal,
         280.0::double + value % 10 AS stl4, value % 1 AS swvl4
  FROM events)"""


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id", "ts AS valid_time", "round(41.2D + 0.1D * (user_id % 5), 1) AS latitude",
        "round(1.9D + 0.1D * ((user_id div 5) % 6), 1) AS longitude",
        "value % 7 - 3 AS u10", "value % 5 - 2 AS v10", "273.15D + value % 40 AS t2m",
        "273.15D + value % 40 - CAST(get_json_object(props, '$.k') AS DOUBLE) % 20 AS d2m",
        "value % 2 AS lai_lv", "value % 3 AS lai_hv", "(event_id % 7) * 0.001D AS tp",
        "(event_id % 11) * 360000.0D AS ssrd", "0.1D + value % 1 / 10 AS fal",
        "280.0D + value % 10 AS stl4", "value % 1 AS swvl4",
    )


# Raw history rows of two stations over several years, one a day.
DAYS = """days AS (
  SELECT max(o_orderkey) AS event_id, o_orderdate AS valid_time, round(41.2::double + 0.1::double * (o_custkey % 2), 1) AS latitude, 2.1::double AS longitude,
         max(o_totalprice) AS value FROM orders GROUP BY o_orderdate, o_custkey % 2),
raw AS (
  SELECT event_id, valid_time, latitude, longitude, value % 7 - 3 AS u10, value % 5 - 2 AS v10, 273.15::double + value % 40 AS t2m,
         273.15::double + value % 40 - event_id % 20 AS d2m, value % 2 AS lai_lv, value % 3 AS lai_hv, (event_id % 7) * 0.001::double AS tp,
         (event_id % 11) * 360000.0::double AS ssrd, 0.1::double + value % 1 / 10 AS fal, 280.0::double + value % 10 AS stl4, value % 1 AS swvl4
  FROM days)"""


def raw_days(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").groupBy(F.expr("o_orderdate AS valid_time"), F.expr("round(41.2D + 0.1D * (o_custkey % 2), 1) AS latitude")).agg(
        F.max("o_orderkey").alias("event_id"), F.max("o_totalprice").alias("value")
    )
    return days.selectExpr(
        "event_id", "valid_time", "latitude", "2.1D AS longitude", "value % 7 - 3 AS u10", "value % 5 - 2 AS v10", "273.15D + value % 40 AS t2m",
        "273.15D + value % 40 - event_id % 20 AS d2m", "value % 2 AS lai_lv", "value % 3 AS lai_hv", "(event_id % 7) * 0.001D AS tp",
        "(event_id % 11) * 360000.0D AS ssrd", "0.1D + value % 1 / 10 AS fal", "280.0D + value % 10 AS stl4", "value % 1 AS swvl4",
    )


# Monthly predictions over several years.
MONTHLY = """monthly AS (
  SELECT o_orderkey, o_orderdate AS time, concat('41.', 31 + o_custkey % 40, '_2.', 11 + o_custkey % 25) AS weatherStation,
         o_totalprice % 40 AS airTemperature, (o_orderkey % 101) / 100.0::double AS relativeHumidity
  FROM orders)"""


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_orderdate AS time",
        "concat('41.', 31 + o_custkey % 40, '_2.', 11 + o_custkey % 25) AS weatherStation",
        "o_totalprice % 40 AS airTemperature", "(o_orderkey % 101) / 100.0D AS relativeHumidity",
    )


# Grid points in degrees.
GRID = """grid AS (
  SELECT c_custkey, round(41.205::double + 0.01::double * (c_custkey % 39), 3) AS lat,
         round(1.905::double + 0.01::double * ((c_custkey // 39) % 49), 3) AS lon
  FROM customer)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr(
        "c_custkey", "round(41.205D + 0.01D * (c_custkey % 39), 3) AS lat",
        "round(1.905D + 0.01D * ((c_custkey div 39) % 49), 3) AS lon",
    )


LOCATIONS = """locations AS (
  SELECT n_name AS name, 41.2::double + 0.015::double * n_nationkey AS lat, 1.9::double + 0.02::double * n_nationkey AS lon
  FROM nation)"""


def locations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").selectExpr(
        "n_name AS name", "41.2D + 0.015D * n_nationkey AS lat", "1.9D + 0.02D * n_nationkey AS lon"
    )


# 100 m cells in metres, rows of 50; a raster of 40 m pixels over them.
CELLS = """cells AS (
  SELECT p_partkey AS cell, 50.0::double + 100 * (p_partkey % 50) AS x, 50.0::double + 100 * (p_partkey // 50) AS y
  FROM part)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "p_partkey AS cell", "50.0D + 100 * (p_partkey % 50) AS x", "50.0D + 100 * (p_partkey div 50) AS y"
    )


# Affine of the raster: x0, dx, y0, dy.
AFFINE = (0.0, 40.0, 3000.0, 40.0)
RASTER = """raster AS (
  SELECT CAST(p_partkey // 50 AS INTEGER) AS "row", CAST(p_partkey % 50 AS INTEGER) AS col, ((p_size * 7) % 201)::double AS value
  FROM part)"""


def raster(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "CAST(p_partkey div 50 AS INT) AS row", "CAST(p_partkey % 50 AS INT) AS col",
        "CAST((p_size * 7) % 201 AS DOUBLE) AS value",
    )


BUILDINGS = """buildings AS (
  SELECT l_orderkey * 10 + l_linenumber AS building_reference, l_partkey % 1000 * 5 + l_linenumber * 0.5::double AS bx,
         l_suppkey % 700 * 4 + l_linenumber * 0.25::double AS by_,
         CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END AS area_a,
         CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END AS area_n,
         CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS area_r, l_quantity AS floors
  FROM lineitem)"""


def buildings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS building_reference", "l_partkey % 1000 * 5 + l_linenumber * 0.5D AS bx",
        "l_suppkey % 700 * 4 + l_linenumber * 0.25D AS by_",
        "CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END AS area_a",
        "CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END AS area_n",
        "CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS area_r", "l_quantity AS floors",
    )


# Observations with repeated keys; the later event arrives later.
OBS = """obs AS (
  SELECT event_id // 2 AS obs_key, event_id AS seq, concat('st', user_id % 40) AS station_id, ts AS datetime, value
  FROM events)"""


def obs(spark: SparkSession, d: str) -> DataFrame:
    return obs_of(table(spark, d, "events"))


def obs_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id div 2 AS obs_key", "event_id AS seq", "concat('st', user_id % 40) AS station_id", "ts AS datetime", "value"
    )


PRED = """pred AS (
  SELECT event_id, ts AS time, concat('41.', 31 + user_id % 4, '_2.', 11 + user_id % 4) AS weatherStation,
         value AS y_a, value + (event_id % 5 - 2) AS pred_a, value % 9 AS y_b, value % 9 + (event_id % 3 - 1) * 0.5::double AS pred_b
  FROM events)"""


def pred(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id", "ts AS time", "concat('41.', 31 + user_id % 4, '_2.', 11 + user_id % 4) AS weatherStation",
        "value AS y_a", "value + (event_id % 5 - 2) AS pred_a", "value % 9 AS y_b",
        "value % 9 + (event_id % 3 - 1) * 0.5D AS pred_b",
    )


# A heat-index surface that is not linear in temperature.
LOOKUP = """lookup AS (
  SELECT t AS tdb, h AS rh, t + 0.00003::double * t * t * h AS heat_index
  FROM range(-20, 61) a(t), range(0, 101) b(h))"""


def surface(tdb, rh):
    return tdb + F.lit(0.00003) * tdb * tdb * rh


# Interpolated heat index of wx on that surface.
HI = WX + ", " + LOOKUP + """, spot AS (
  SELECT *, airTemperature + 20 AS px, relativeHumidity * 100 AS py,
         greatest(0, least(79, floor(airTemperature + 20)))::int AS i,
         greatest(0, least(99, floor(relativeHumidity * 100)))::int AS j FROM wx),
hi AS (
  SELECT spot.* EXCLUDE (px, py, i, j),
         a.heat_index * (1 - (px - i)) * (1 - (py - j)) + b.heat_index * (1 - (px - i)) * (py - j)
       + c.heat_index * (px - i) * (1 - (py - j)) + e.heat_index * (px - i) * (py - j) AS heatIndex
  FROM spot
  JOIN lookup a ON a.tdb = i - 20 AND a.rh = j
  JOIN lookup b ON b.tdb = i - 20 AND b.rh = j + 1
  JOIN lookup c ON c.tdb = i - 19 AND c.rh = j
  JOIN lookup e ON e.tdb = i - 19 AND e.rh = j + 1)"""

DAILY = HI + """, daily AS (
  SELECT CAST(time AS DATE) AS date, weatherStation,
         min(CASE WHEN hour(time) <= 8 OR hour(time) >= 21 THEN heatIndex END) AS night_temp_min,
         avg(CASE WHEN hour(time) <= 8 OR hour(time) >= 21 THEN heatIndex END) AS night_temp_mean,
         max(CASE WHEN hour(time) <= 8 OR hour(time) >= 21 THEN heatIndex END) AS night_temp_max,
         min(CASE WHEN hour(time) BETWEEN 9 AND 20 THEN heatIndex END) AS day_temp_min,
         avg(CASE WHEN hour(time) BETWEEN 9 AND 20 THEN heatIndex END) AS day_temp_mean,
         max(CASE WHEN hour(time) BETWEEN 9 AND 20 THEN heatIndex END) AS day_temp_max
  FROM hi GROUP BY 1, 2)"""
