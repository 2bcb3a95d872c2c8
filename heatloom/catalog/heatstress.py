"""Aggregates and heat-stress indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import heat, model, order, quantile_state, spatial, tables
from ..plans import indicators
from ..session import scratch_path
from . import views as v
from .registry import query, r6, rounded, sql_r6

STATS = [f"{a}_temp_{b}" for a in ("night", "day") for b in ("min", "mean", "max")]


def _text_date(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def _lookup(s):
    return heat.build_lookup(s, v.surface)


# ---- heat chain ----

NEAR_POINT = v.WX + """, p AS (SELECT *, CAST(floor(airTemperature + 0.5) AS INTEGER) AS tdb, CAST(floor(relativeHumidity * 100 + 0.5) AS INTEGER) AS rh FROM wx)"""
FAHRENHEIT = """, f AS (SELECT *, tdb * 1.8::double + 32 AS t FROM p), g AS (SELECT *, (0.5::double * (t + 61 + (t - 68) * 1.2::double + rh * 0.094::double) + t) / 2 AS simple FROM f),
h AS (SELECT *, (CASE WHEN simple >= 80 THEN -42.379::double + 2.04901523::double * t + 10.14333127::double * rh - 0.22475541::double * t * rh - 0.00683783::double * t * t
 - 0.05481717::double * rh * rh + 0.00122874::double * t * t * rh + 0.00085282::double * t * rh * rh - 0.00000199::double * t * t * rh * rh ELSE simple END - 32) / 1.8::double AS heat_index FROM g)"""


@query("k1_lookup_surface", f"WITH {NEAR_POINT}{FAHRENHEIT} SELECT tdb, rh, count(*) AS n, round(max(heat_index), 6) + 0.0::double AS heat_index FROM h GROUP BY 1, 2")
def _(s, d):
    points = v.wx(s, d).select(
        F.floor(F.col("airTemperature") + 0.5).cast("int").alias("tdb"),
        F.floor(F.col("relativeHumidity") * 100 + 0.5).cast("int").alias("rh"),
    )
    seen = points.groupBy("tdb", "rh").agg(F.count("*").alias("n"))
    return rounded(seen.join(heat.build_lookup(s), ["tdb", "rh"]), "heat_index")


# Interpolated values are multiples of 1e-7: eight digits hold them whole. Their
# means can end in an exact half there; the offset moves both engines off it.
def _r8(df, *cols):
    return df.withColumns({c: F.round(F.col(c) + 1e-11, 8) for c in cols})


def _sql_r8(*cols: str) -> str:
    return ", ".join(f"round({c} + 1e-11::double, 8) AS {c}" for c in cols)


@query("k2_bilinear", f"WITH {v.HI} SELECT event_id, weatherStation, {_sql_r8('heatIndex')} FROM hi")
def _(s, d):
    return _r8(heat.with_heat_index(v.wx(s, d), _lookup(s)).select("event_id", "weatherStation", "heatIndex"), "heatIndex")


DAILY_OUT = f"SELECT CAST(date AS VARCHAR) AS date, weatherStation, {_sql_r8(*STATS)}"


@query("k3_daily_heat", f"WITH {v.DAILY} {DAILY_OUT} FROM daily")
def _(s, d):
    return _r8(_text_date(indicators.daily_heat(v.wx(s, d), _lookup(s)), "date"), *STATS)


@query("a1_daily_stats", f"""WITH {v.DAILY.replace('FROM hi GROUP', 'FROM (SELECT *, airTemperature AS t FROM hi) GROUP').replace('THEN heatIndex', 'THEN t')} {DAILY_OUT} FROM daily""")
def _(s, d):
    return _r8(_text_date(heat.daily_stats(v.wx(s, d), "airTemperature"), "date"), *STATS)


# Written out, so that a changed limit in the operators shows.
FLAGS = {
    "heatWave": "low > 33",
    "tropicalNight": "night_temp_min > 20",
    "torridNight": "night_temp_min > 25",
    "infernalNight": "night_temp_min > 30",
}
for _c, _suffix in (("day_temp_max", "MaxTemperature"), ("day_temp_mean", "AverageTemperature")):
    FLAGS |= {
        f"safe{_suffix}": f"{_c} < 27",
        f"caution{_suffix}": f"{_c} >= 27 AND {_c} < 33",
        f"extremeCaution{_suffix}": f"{_c} >= 33 AND {_c} < 41",
        f"hazardous{_suffix}": f"{_c} >= 41 AND {_c} < 52",
        f"extremeHazardous{_suffix}": f"{_c} >= 52 AND {_c} < 92",
        f"beyondHumanLimit{_suffix}": f"{_c} >= 92",
    }
ROLLED = v.DAILY + """, rolled AS (SELECT *, min(day_temp_max) OVER (PARTITION BY weatherStation ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS low FROM daily)"""


@query("k4_heat_flags", f"WITH {ROLLED} SELECT CAST(date AS VARCHAR) AS date, weatherStation, {', '.join(f'coalesce({e}, false) AS {n}' for n, e in FLAGS.items())} FROM rolled")
def _(s, d):
    flags = heat.heat_flags(indicators.daily_heat(v.wx(s, d), _lookup(s)))
    return _text_date(flags, "date").select("date", "weatherStation", *[F.coalesce(n, F.lit(False)).alias(n) for n in FLAGS])


YEARLY = f"WITH {ROLLED} SELECT weatherStation, CAST(year(date) AS INTEGER) AS year, {', '.join(f'count(*) FILTER ({e}) AS {n}' for n, e in FLAGS.items())} FROM rolled GROUP BY 1, 2"


@query("k5_yearly_heat", YEARLY)
def yearly_heat(s, d):
    return indicators.yearly_heat(v.wx(s, d), _lookup(s))


@query("a2_yearly_counts", f"""WITH {v.MONTHLY}, f AS (SELECT weatherStation, CAST(time AS DATE) AS date, airTemperature > 33 AS hot, CASE WHEN relativeHumidity > 0.1 THEN relativeHumidity < 0.3 END AS dry FROM monthly)
SELECT weatherStation, CAST(year(date) AS INTEGER) AS year, count(*) FILTER (hot) AS hot, count(*) FILTER (dry) AS dry FROM f GROUP BY 1, 2""")
def _(s, d):
    f = v.monthly(s, d).select(
        "weatherStation", F.to_date("time").alias("date"), (F.col("airTemperature") > 33).alias("hot"),
        F.when(F.col("relativeHumidity") > 0.1, F.col("relativeHumidity") < 0.3).alias("dry"),
    )
    return heat.yearly_counts(f, ["hot", "dry"])


NEAR = f"""{v.LOCATIONS}, st AS (SELECT DISTINCT weatherStation, CAST(split_part(weatherStation, '_', 1) AS DOUBLE) AS slat, CAST(split_part(weatherStation, '_', 2) AS DOUBLE) AS slon FROM wx),
near AS (SELECT name, arg_min(weatherStation, (sqrt((slat - lat) ** 2 + (slon - lon) ** 2), weatherStation)) AS weatherStation FROM locations, st GROUP BY name)"""


@query("k6_location_daily", f"""WITH {v.HI}, {NEAR}, ls AS (SELECT hi.*, name AS locationName FROM hi JOIN near USING (weatherStation))
SELECT CAST(CAST(time AS DATE) AS VARCHAR) AS date, locationName,
 {', '.join(f"round({fn}(CASE WHEN {m} THEN heatIndex END) + 1e-11::double, 8) AS {side}_temp_{n}" for side, m in (('night', 'NOT hour(time) BETWEEN 9 AND 20'), ('day', 'hour(time) BETWEEN 9 AND 20')) for n, fn in (('min', 'min'), ('mean', 'avg'), ('max', 'max')))}
FROM ls GROUP BY 1, 2""")
def _(s, d):
    return _r8(_text_date(heat.location_daily(v.wx(s, d), v.locations(s, d), _lookup(s)), "date"), *STATS)


@query("k7_slice_for_map", f"""WITH {v.MONTHLY} SELECT o_orderkey, CAST(split_part(weatherStation, '_', 1) AS DOUBLE) AS latitude, CAST(split_part(weatherStation, '_', 2) AS DOUBLE) AS longitude
FROM monthly WHERE year(time) * 100 + month(time) IN (199612, 199701)""")
def _(s, d):
    from ..functions.clock import year_month

    m = v.monthly(s, d).withColumn("ym", year_month(F.col("time")))
    return heat.slice_for_map(m, "1997-01-15 00:00:00").select("o_orderkey", "latitude", "longitude")


# ---- other aggregates ----

A3_SQL = f"""WITH {v.BUILDINGS}, {v.CELLS}, j AS (SELECT cell, b.* FROM buildings b JOIN cells c ON abs(b.bx - c.x) < 50 AND abs(b.by_ - c.y) < 50)
SELECT cell, round(sum(area_a), 2) + 0.0::double AS area_a, round(sum(area_n), 2) + 0.0::double AS area_n, round(sum(area_r), 2) + 0.0::double AS area_r, round(avg(floors), 6) AS floors FROM j GROUP BY cell"""


def building_cells(s, d):
    return spatial.points_in_cells(v.buildings(s, d), v.cells(s, d), 50.0, "bx", "by_")


@query("a3_cell_attributes", A3_SQL)
def _(s, d):
    out = spatial.cell_attributes(building_cells(s, d), "cell", ["area_a", "area_n", "area_r"], ["floors"])
    return out.select("cell", *[(F.round(c, 2) + 0.0).alias(c) for c in ("area_a", "area_n", "area_r")], F.round("floors", 6).alias("floors"))


QUANTILES = f"""WITH {v.WX}, l AS (SELECT weatherStation, 'airTemperature' AS variable, airTemperature AS x FROM wx UNION ALL SELECT weatherStation, 'relativeHumidity', relativeHumidity FROM wx)
SELECT weatherStation, variable, round(quantile_cont(x, 0.05), 6) + 0.0::double AS q05, round(quantile_cont(x, 0.95), 6) + 0.0::double AS q95 FROM l GROUP BY 1, 2"""


STATE = f"""WITH {v.WX}, long AS (UNPIVOT (SELECT weatherStation, airTemperature, relativeHumidity FROM wx) ON airTemperature, relativeHumidity INTO NAME variable VALUE value),
state AS (SELECT weatherStation, variable, CASE WHEN value = 0 THEN 0 ELSE sign(value) * floor((log2(abs(value)) + 1100) * 512 + power(2, -20)) END AS bucket, count(*) AS n, min(value) AS least, max(value) AS greatest
  FROM long WHERE value IS NOT NULL GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY weatherStation, variable ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY weatherStation, variable) AS t FROM state),
want AS (SELECT *, p * (t - 1) AS pos, least(floor(p * (t - 1)) + step, t - 1) AS k FROM run, (VALUES (0.05::double), (0.95::double)) q(p), (VALUES (0), (1)) w(step)),
hit AS (SELECT weatherStation, variable, p, step, pos - floor(pos) AS part, least + (greatest - least) * CASE WHEN n = 1 THEN 0 ELSE (k - (c - n)) / (n - 1)::double END AS x FROM want WHERE k >= c - n AND k < c),
mix AS (SELECT weatherStation, variable, p, max(x) FILTER (step = 0) + (max(x) FILTER (step = 1) - max(x) FILTER (step = 0)) * max(part) AS q FROM hit GROUP BY 1, 2, 3)
SELECT weatherStation, variable, round(max(q) FILTER (p < 0.5), 6) + 0.0::double AS q05, round(max(q) FILTER (p > 0.5), 6) + 0.0::double AS q95 FROM mix GROUP BY 1, 2"""


@query("a5_merged_quantiles", STATE)
def _(s, d):
    """Added to the store in three batches, one of them twice."""
    root = scratch_path(s, "quantile-state")
    w = v.wx(s, d)
    for batch in (0, 1, 1, 2):
        quantile_state.add_to_stored_state(w.where(f"day(time) % 3 = {batch}"), root, str(batch), ["airTemperature", "relativeHumidity"])
    return rounded(quantile_state.stored_stats(s, root), "q05", "q95")


@query("a5_quantile_stats", QUANTILES)
def _(s, d):
    return rounded(order.quantile_stats(v.wx(s, d), ["airTemperature", "relativeHumidity"]), "q05", "q95")


@query("a6_time_bounds", "SELECT min(ts) AS first_time, max(ts) AS last_time FROM events")
def _(s, d):
    return tables.time_bounds(v.wx(s, d))


@query("a7_minmax_01", """WITH b AS (SELECT min(p_size) AS a0, max(p_size) AS a1, min(p_retailprice) AS b0, max(p_retailprice) AS b1 FROM part)
SELECT p_partkey, round((p_size - a0) / (a1 - a0)::double, 6) + 0.0::double AS p_size, round((p_retailprice - b0) / (b1 - b0), 6) + 0.0::double AS p_retailprice, 0.0::double AS c FROM part, b""")
def _(s, d):
    p = v.table(s, d, "part").selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS p_size", "p_retailprice", "5.0D AS c")
    return rounded(order.minmax_01(p, ["p_size", "p_retailprice", "c"]), "p_size", "p_retailprice", "c")


@query("a8_max_update_mark", "SELECT max(o_orderdate) AS mark FROM orders")
def _(s, d):
    return v.table(s, d, "orders").agg(F.max("o_orderdate").alias("mark"))


@query("a9_distinct_values", f"WITH {v.MONTHLY} SELECT DISTINCT weatherStation FROM monthly")
def _(s, d):
    return tables.distinct_values(v.monthly(s, d), "weatherStation")


RMSE = f"""WITH {v.PRED}, e AS (SELECT sqrt(avg((y_a - pred_a) ** 2)) AS a, sqrt(avg((y_b - pred_b) ** 2)) AS b FROM pred)
SELECT round(a, 6) AS rmse_y_a, round(b, 6) AS rmse_y_b, round((a + b) / 2, 6) AS rmse FROM e"""


def _rmse(s, d):
    return rounded(model.rmse(v.pred(s, d), {"y_a": "pred_a", "y_b": "pred_b"}), "rmse_y_a", "rmse_y_b", "rmse")


query("a10_rmse", RMSE)(_rmse)


@query("m7_evaluate_sets", f"""WITH {v.PRED}, e AS (SELECT event_id % 10 = 0 AS held, sqrt(avg((y_a - pred_a) ** 2)) AS a, sqrt(avg((y_b - pred_b) ** 2)) AS b FROM pred GROUP BY 1)
SELECT held, round(a, 6) AS rmse_y_a, round(b, 6) AS rmse_y_b, round((a + b) / 2, 6) AS rmse FROM e""")
def _(s, d):
    p = v.pred(s, d)
    pairs = {"y_a": "pred_a", "y_b": "pred_b"}
    parts = [model.rmse(p.where(f"(event_id % 10 = 0) = {x}"), pairs).withColumn("held", F.lit(x)) for x in (True, False)]
    return rounded(tables.union_all(*parts), "rmse_y_a", "rmse_y_b", "rmse")


@query("a12_grouped_series_columns", f"""WITH {v.WX}, dly AS (SELECT weatherStation, CAST(time AS DATE) AS date, max(airTemperature) AS m, min(airTemperature) AS n FROM wx GROUP BY 1, 2)
SELECT weatherStation, CAST(date AS VARCHAR) AS date, round(min(m) OVER w, 6) + 0.0::double AS low, round(n, 6) + 0.0::double AS n FROM dly WINDOW w AS (PARTITION BY weatherStation ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(s, d):
    from ..operators.series import rolling_min

    daily = v.wx(s, d).groupBy("weatherStation", F.to_date("time").alias("date")).agg(
        F.max("airTemperature").alias("m"), F.min("airTemperature").alias("n")
    )
    return rounded(_text_date(rolling_min(daily, "m", time="date", alias="low").drop("m"), "date"), "low", "n")


@query("a13_check_rectangular", f"""WITH {v.MONTHLY}, c AS (SELECT count(*) AS n_rows, count(DISTINCT time) AS n_times, count(DISTINCT weatherStation) AS n_stations FROM monthly)
SELECT *, n_rows = n_times * n_stations AS rectangular FROM c""")
def _(s, d):
    return tables.check_rectangular(v.monthly(s, d))


@query("a14_lookup_grid", f"WITH {NEAR_POINT}{FAHRENHEIT} SELECT tdb, round(max(heat_index) FILTER (rh = 20), 6) AS rh20, round(max(heat_index) FILTER (rh = 50), 6) AS rh50, round(max(heat_index) FILTER (rh = 80), 6) AS rh80 FROM h GROUP BY tdb")
def _(s, d):
    points = v.wx(s, d).select(
        F.floor(F.col("airTemperature") + 0.5).cast("int").alias("tdb"), F.floor(F.col("relativeHumidity") * 100 + 0.5).cast("int").alias("rh")
    ).distinct()
    g = heat.lookup_grid(points.join(heat.build_lookup(s), ["tdb", "rh"]), [20, 50, 80])
    return g.select("tdb", *[r6(F.col(f"`{h}`")).alias(f"rh{h}") for h in (20, 50, 80)])


@query("a15_degree_days", f"""WITH {v.MONTHLY}, dly AS (SELECT weatherStation, CAST(time AS DATE) AS date, avg(airTemperature) AS m FROM monthly GROUP BY 1, 2)
SELECT weatherStation, CAST(year(date) AS INTEGER) AS year, round(sum(greatest(0, 18 - m)), 4) + 0.0::double AS HDD, round(sum(greatest(0, m - 21)), 4) + 0.0::double AS CDD FROM dly GROUP BY 1, 2""")
def _(s, d):
    out = heat.degree_days(v.monthly(s, d))
    return out.withColumns({c: F.round(c, 4) + 0.0 for c in ("HDD", "CDD")})


@query("a16_row_share", """SELECT l_orderkey, l_linenumber, round(l_quantity * 100 / (l_quantity + l_discount + l_tax), 6) AS l_quantity, round(l_discount * 100 / (l_quantity + l_discount + l_tax), 6) AS l_discount,
 round(l_tax * 100 / (l_quantity + l_discount + l_tax), 6) AS l_tax FROM lineitem""")
def _(s, d):
    cols = ["l_quantity", "l_discount", "l_tax"]
    return rounded(tables.row_share(v.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *cols), cols), *cols)
