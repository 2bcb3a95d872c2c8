"""Filters, projections, joins and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, geo, keys, solar, weather
from ..operators import heat, model, spatial, tables
from . import views as v
from .registry import query, r6, rounded, sql_r6

BOX = (41.25, 41.5, 1.95, 2.3)


# ---- filters and projections ----


@query("p1_rename_present", f"WITH {v.RAW} SELECT event_id, u10 AS windSpeedEast, t2m AS airTemperature FROM raw")
def _(s, d):
    from ..plans.harmonise import HISTORY_VARIABLES

    return tables.rename_present(v.raw(s, d).select("event_id", "u10", "t2m"), HISTORY_VARIABLES)


@query("p2_drop_columns", f"WITH {v.WX} SELECT event_id, weatherStation, relativeHumidity FROM wx")
def _(s, d):
    return v.wx(s, d).drop("time", "airTemperature", "absent")


@query("p3_drop_nulls", """SELECT event_id, CASE WHEN value > 10 THEN value END AS a, CASE WHEN user_id % 3 > 0 THEN user_id END AS b FROM events
WHERE value > 10 AND user_id % 3 > 0""")
def _(s, d):
    e = v.table(s, d, "events").selectExpr(
        "event_id", "CASE WHEN value > 10 THEN value END AS a", "CASE WHEN user_id % 3 > 0 THEN user_id END AS b"
    )
    return tables.drop_nulls(e)


@query("p4_text_to_time", """SELECT event_id, CASE WHEN event_id % 5 > 0 THEN date_trunc('second', ts) END AS time FROM events""")
def _(s, d):
    text = F.when(F.col("event_id") % 5 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("not a time")
    return v.table(s, d, "events").select("event_id", clock.to_time(text).alias("time"))


@query("p5_fixed_order", f"WITH {v.RAW} SELECT event_id, tp, u10, v10 FROM raw")
def _(s, d):
    return v.raw(s, d).select("event_id", *["tp", "u10", "v10"])


@query("p6_within_bbox", f"""WITH {v.GRID} SELECT c_custkey, lat, lon FROM grid WHERE lat > {BOX[0]}::double AND lat < {BOX[1]}::double AND lon > {BOX[2]}::double AND lon < {BOX[3]}::double""")
def _(s, d):
    return tables.within_bbox(v.grid(s, d), "lat", "lon", BOX)


@query("p10_isin_keys", f"WITH {v.WX} SELECT event_id, weatherStation FROM wx WHERE weatherStation IN ('41.31_2.11', '41.34_2.14', 'none')")
def _(s, d):
    return tables.isin_keys(v.wx(s, d), "weatherStation", ["41.31_2.11", "41.34_2.14", "none"]).select("event_id", "weatherStation")


@query("p10_isin_key_table", f"WITH {v.MONTHLY} SELECT o_orderkey, weatherStation FROM monthly WHERE weatherStation IN (SELECT weatherStation FROM monthly WHERE airTemperature > 39.9)")
def _(s, d):
    m = v.monthly(s, d)
    return tables.isin_keys(m, "weatherStation", m.where("airTemperature > 39.9").select("weatherStation")).select("o_orderkey", "weatherStation")


@query("p11_at_time", f"WITH {v.MONTHLY} SELECT o_orderkey, weatherStation, {sql_r6('airTemperature')} FROM monthly WHERE time = TIMESTAMP '1996-06-17 00:00:00'")
def _(s, d):
    return rounded(tables.at_time(v.monthly(s, d), "1996-06-17 00:00:00").select("o_orderkey", "weatherStation", "airTemperature"), "airTemperature")


@query("p12_exceedances", f"""WITH {v.WX} SELECT event_id, 'airTemperature' AS variable, round(airTemperature, 6) AS value FROM wx WHERE airTemperature > 33
UNION ALL SELECT event_id, 'relativeHumidity', round(relativeHumidity, 6) FROM wx WHERE relativeHumidity < 0.2""")
def _(s, d):
    limits = {"airTemperature": (33.0, "above"), "relativeHumidity": (0.2, "below")}
    return rounded(tables.exceedances(v.wx(s, d), limits, ["event_id"]), "value")


@query("p13_select_times", f"WITH {v.MONTHLY} SELECT o_orderkey, time FROM monthly WHERE time IN (SELECT time FROM monthly WHERE airTemperature < 0.5)")
def _(s, d):
    m = v.monthly(s, d)
    return tables.select_times(m, m.where("airTemperature < 0.5").select("time").distinct()).select("o_orderkey", "time")


@query("p14_night_and_day", f"WITH {v.WX} SELECT event_id, hour(time) <= 8 OR hour(time) >= 21 AS night, hour(time) BETWEEN 9 AND 20 AS day FROM wx")
def _(s, d):
    t = F.col("time")
    return v.wx(s, d).select("event_id", clock.is_night(t).alias("night"), clock.is_day(t).alias("day"))


@query("p15_replace_with_suffixed", "SELECT event_id, value * 2 AS value, user_id FROM events")
def _(s, d):
    e = v.table(s, d, "events").select("event_id", "user_id", "value", (F.col("value") * 2).alias("value_avg"))
    return tables.replace_with_suffixed(e)


@query("p16_select_suffix", "SELECT event_id, value AS a_percentile FROM events")
def _(s, d):
    e = v.table(s, d, "events").select("event_id", "user_id", F.col("value").alias("a_percentile"))
    return tables.select_suffix(e, "_percentile", ["event_id"])


@query("p17_label_keys", """SELECT s_suppkey, concat('n', s_nationkey) AS weatherStation, coalesce(label, concat('n', s_nationkey)) AS locationName
FROM supplier LEFT JOIN (SELECT concat('n', n_nationkey) AS k, n_name AS label FROM nation WHERE n_regionkey < 3
UNION ALL SELECT concat('n', n_nationkey), concat('second ', n_name) FROM nation WHERE n_regionkey = 0) ON k = concat('n', s_nationkey)""")
def _(s, d):
    n = v.table(s, d, "nation").withColumn("weatherStation", F.expr("concat('n', n_nationkey)"))
    labels = n.where("n_regionkey < 3").selectExpr("weatherStation", "n_name AS label").unionByName(
        n.where("n_regionkey = 0").selectExpr("weatherStation", "concat('second ', n_name) AS label")
    )
    sup = v.table(s, d, "supplier").selectExpr("s_suppkey", "concat('n', s_nationkey) AS weatherStation")
    return tables.label_keys(sup, "weatherStation", labels)


@query("p19_static_store_columns", f"WITH {v.CELLS} SELECT cell, x FROM cells")
def _(s, d):
    from ..sources.tables import static_store_columns

    return static_store_columns(v.cells(s, d).withColumn("geometry", F.lit("x")), ["y", "geometry", "absent"])


# ---- joins ----


@query("j1_join_variables", f"""WITH {v.RAW}, k AS (SELECT event_id AS k, round(t2m, 2) AS temp, u10, v10 FROM raw)
SELECT a.k, {sql_r6('temp', 'u10', 'v10')} FROM (SELECT k, temp FROM k) a JOIN (SELECT k, u10 FROM k WHERE u10 > 0) b USING (k) JOIN (SELECT k, v10 FROM k WHERE v10 > 0) c USING (k)""")
def _(s, d):
    r = v.raw(s, d).selectExpr("event_id AS k", "round(t2m, 2) AS temp", "u10", "v10")
    parts = [r.select("k", "temp"), r.where("u10 > 0").select("k", "u10"), r.where("v10 > 0").select("k", "v10")]
    return rounded(tables.join_variables(parts, ["k"]), "temp", "u10", "v10")


@query("j1_pivot_variables", f"""WITH {v.RAW} SELECT event_id, {sql_r6('u10', 'v10')} FROM raw WHERE u10 > 0 AND v10 > 0""")
def _(s, d):
    long = v.raw(s, d).select("event_id", "u10", "v10").unpivot(["event_id"], ["u10", "v10"], "variable", "value").where("value > 0")
    return rounded(tables.pivot_variables(long, ["event_id"], ["u10", "v10"]), "u10", "v10")


@query("j2_attach_coords", f"""WITH {v.GRID} SELECT o_orderkey, lat, lon FROM orders LEFT JOIN (SELECT c_custkey, lat, lon FROM grid WHERE c_custkey % 4 > 0) ON o_custkey = c_custkey""")
def _(s, d):
    o = v.table(s, d, "orders").selectExpr("o_orderkey", "o_custkey AS x", "0 AS y")
    coords = v.grid(s, d).where("c_custkey % 4 > 0").selectExpr("c_custkey AS x", "0 AS y", "lat", "lon")
    return tables.attach_coords(o, coords)


@query("j3_left_join_variables", f"""WITH {v.RAW} SELECT a.event_id, {sql_r6('t2m', 'u10')} FROM (SELECT event_id, t2m FROM raw) a LEFT JOIN (SELECT event_id, u10 FROM raw WHERE u10 > 1) b USING (event_id)""")
def _(s, d):
    r = v.raw(s, d)
    both = tables.join_variables([r.select("event_id", "t2m"), r.where("u10 > 1").select("event_id", "u10", "t2m")], ["event_id"], "left")
    return rounded(both, "t2m", "u10")


SIDES = f"""WITH {v.WX}, n AS (SELECT weatherStation, CAST(time AS DATE) AS date, max(airTemperature) AS night FROM wx WHERE hour(time) < 3 AND day(time) % 3 > 0 GROUP BY 1, 2),
y AS (SELECT weatherStation, CAST(time AS DATE) AS date, max(airTemperature) AS day FROM wx WHERE hour(time) BETWEEN 10 AND 11 AND day(time) % 4 > 0 GROUP BY 1, 2)"""


def _sides(s, d):
    w = v.wx(s, d).withColumn("date", F.to_date("time"))
    night = w.where("hour(time) < 3 AND day(time) % 3 > 0").groupBy("weatherStation", "date").agg(F.max("airTemperature").alias("night"))
    day = w.where("hour(time) BETWEEN 10 AND 11 AND day(time) % 4 > 0").groupBy("weatherStation", "date").agg(F.max("airTemperature").alias("day"))
    return night, day


@query("j6_full_join_coalesced", SIDES + f" SELECT weatherStation, CAST(date AS VARCHAR) AS date, {sql_r6('night', 'day')} FROM n FULL JOIN y USING (weatherStation, date)")
def _(s, d):
    out = tables.full_join_coalesced(*_sides(s, d), ["weatherStation", "date"])
    return rounded(out.withColumn("date", F.col("date").cast("string")), "night", "day")


@query("j6_full_join_left_keys", SIDES + f" SELECT n.weatherStation, CAST(n.date AS VARCHAR) AS date, {sql_r6('night', 'day')} FROM n FULL JOIN y ON n.weatherStation = y.weatherStation AND n.date = y.date")
def _(s, d):
    out = tables.full_join_coalesced(*_sides(s, d), ["weatherStation", "date"], parity=True)
    return rounded(out.withColumn("date", F.col("date").cast("string")), "night", "day")


@query("j7_join_predicted_variables", f"""WITH {v.PRED} SELECT event_id, a.weatherStation, pred_a, pred_b FROM (SELECT event_id, time, weatherStation, pred_a FROM pred) a
JOIN (SELECT event_id, time, weatherStation, pred_b FROM pred WHERE y_b > 2) b USING (event_id, time)""")
def _(s, d):
    p = v.pred(s, d)
    out = tables.join_variables(
        [p.select("event_id", "time", "weatherStation", "pred_a"), p.where("y_b > 2").select("event_id", "time", "weatherStation", "pred_b")],
        ["event_id", "time", "weatherStation"],
    )
    return out.drop("time")


NEAREST = f"""WITH {v.GRID}, {v.LOCATIONS}, st AS (SELECT DISTINCT concat(lat, '_', lon) AS weatherStation, lat, lon FROM grid)
SELECT name, arg_min(weatherStation, (sqrt((st.lat - l.lat) ** 2 + (st.lon - l.lon) ** 2), weatherStation)) AS weatherStation,
       round(min(sqrt((st.lat - l.lat) ** 2 + (st.lon - l.lon) ** 2)), 6) + 0.0::double AS dist FROM locations l, st GROUP BY name"""


def _nearest(s, d):
    st = v.grid(s, d).select(keys.station_key(F.col("lat"), F.col("lon")).alias("weatherStation"), "lat", "lon")
    return rounded(spatial.nearest(v.locations(s, d), st), "dist")


query("j8_nearest_station", NEAREST)(_nearest)
query("o4_top_one_by_distance", NEAREST.replace("SELECT name, arg_min", "SELECT name AS place, arg_min").replace("GROUP BY name", "GROUP BY name"))(
    lambda s, d: _nearest(s, d).withColumnRenamed("name", "place")
)


@query("j8_k_nearest", f"""WITH {v.GRID}, {v.LOCATIONS}, st AS (SELECT DISTINCT concat(lat, '_', lon) AS weatherStation, lat, lon FROM grid),
d AS (SELECT name, weatherStation, sqrt((st.lat - l.lat) ** 2 + (st.lon - l.lon) ** 2) AS dist FROM locations l, st)
SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY dist, weatherStation) AS INTEGER) AS rank, weatherStation, round(dist, 6) + 0.0::double AS dist FROM d QUALIFY rank <= 5""")
def _(s, d):
    st = v.grid(s, d).select(keys.station_key(F.col("lat"), F.col("lon")).alias("weatherStation"), "lat", "lon")
    return rounded(spatial.k_nearest(v.locations(s, d), st, 5), "dist")


@query("j14_attach_order", """WITH t AS (SELECT DISTINCT ts AS time FROM events), r AS (
  SELECT time, row_number() OVER (ORDER BY md5(concat(strftime(time, '%Y-%m-%d %H:%M:%S.%f'), '|42')), time) AS position FROM t)
SELECT event_id, CAST(position AS BIGINT) AS position FROM events JOIN r ON ts = time""")
def _(s, d):
    from ..operators.order import shuffled_rank

    w = v.wx(s, d).select("event_id", "time")
    return w.join(shuffled_rank(w.select("time").distinct(), "time", 42, "position"), "time").select("event_id", "position")


@query("j16_rows_at_listed_times", f"WITH {v.MONTHLY} SELECT o_orderkey, time FROM monthly WHERE time IN (SELECT time FROM monthly WHERE relativeHumidity > 0.99)")
def _(s, d):
    m = v.monthly(s, d)
    return tables.isin_keys(m, "time", m.where("relativeHumidity > 0.99").select("time")).select("o_orderkey", "time")


# ---- column functions ----


@query("f1_kelvin_to_celsius", f"WITH {v.RAW} SELECT event_id, round(t2m - 273.15::double, 6) + 0.0::double AS celsius FROM raw")
def _(s, d):
    return v.raw(s, d).select("event_id", r6(weather.kelvin_to_celsius(F.col("t2m"))).alias("celsius"))


@query("f2_wind_speed", f"WITH {v.RAW} SELECT event_id, round(sqrt(u10 ** 2 + v10 ** 2), 6) + 0.0::double AS windSpeed FROM raw")
def _(s, d):
    return v.raw(s, d).select("event_id", r6(weather.wind_speed(F.col("u10"), F.col("v10"))).alias("windSpeed"))


@query("f3_wind_direction", f"WITH {v.RAW} SELECT event_id, round((180 + degrees(atan2(u10, v10))) % 360, 6) + 0.0::double AS windDirection FROM raw")
def _(s, d):
    return v.raw(s, d).select("event_id", r6(weather.wind_direction(F.col("u10"), F.col("v10"))).alias("windDirection"))


@query("f4_relative_humidity", f"""WITH {v.RAW}, c AS (SELECT event_id, t2m - 273.15::double AS t, d2m - 273.15::double AS td FROM raw)
SELECT event_id, round(exp(17.67::double * td / (td + 243.5::double)) / exp(17.67::double * t / (t + 243.5::double)), 6) + 0.0::double AS relativeHumidity FROM c""")
def _(s, d):
    t, td = weather.kelvin_to_celsius(F.col("t2m")), weather.kelvin_to_celsius(F.col("d2m"))
    return v.raw(s, d).select("event_id", r6(weather.relative_humidity(t, td)).alias("relativeHumidity"))


@query("f5_station_key", f"WITH {v.GRID} SELECT c_custkey, concat(lat, '_', lon) AS weatherStation FROM grid")
def _(s, d):
    return v.grid(s, d).select("c_custkey", keys.station_key(F.col("lat"), F.col("lon")).alias("weatherStation"))


@query("f6_parse_station_key", f"""WITH {v.WX} SELECT event_id, CAST(split_part(weatherStation, '_', 1) AS DOUBLE) AS latitude, CAST(split_part(weatherStation, '_', 2) AS DOUBLE) AS longitude FROM wx""")
def _(s, d):
    k = F.col("weatherStation")
    return v.wx(s, d).select("event_id", keys.station_lat(k).alias("latitude"), keys.station_lon(k).alias("longitude"))


@query("f7_time_parts", f"""WITH {v.MONTHLY} SELECT o_orderkey, CAST(hour(time) AS INTEGER) AS hour, CAST(month(time) AS INTEGER) AS month, CAST(CAST(time AS DATE) AS VARCHAR) AS date, CAST(year(time) AS INTEGER) AS year FROM monthly""")
def _(s, d):
    return clock.time_parts(v.monthly(s, d)).select("o_orderkey", "hour", "month", F.col("date").cast("string").alias("date"), "year")


FOURIER = ", ".join(
    f"round({f}(2 * pi() * {h} * {p}(time) / {n}), 6) + 0.0::double AS {p}_{h}_{f}"
    for p, n in (("hour", 24), ("month", 12)) for h in (1, 2, 3, 4) for f in ("sin", "cos")
)


@query("f8_fourier", f"WITH {v.WX} SELECT event_id, {FOURIER} FROM wx")
def _(s, d):
    names = [f"{p}_{h}_{f}" for p in ("hour", "month") for h in (1, 2, 3, 4) for f in ("sin", "cos")]
    return rounded(clock.fourier(v.wx(s, d), "time", 4).select("event_id", *names), *names)


@query("f9_camel_to_words", """WITH n AS (SELECT p_partkey, concat('air', upper(substr(p_name, 1, 1)), substr(split_part(p_name, ' ', 1), 2), 'GHIValue', p_size) AS name FROM part)
SELECT p_partkey, lower(regexp_replace(regexp_replace(name, '(.)([A-Z][a-z]+)', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS words FROM n""")
def _(s, d):
    name = F.expr("concat('air', upper(substr(p_name, 1, 1)), substr(split_part(p_name, ' ', 1), 2), 'GHIValue', p_size)")
    return v.table(s, d, "part").select("p_partkey", keys.camel_to_words(name).alias("words"))


@query("f10_parse_model_name", """SELECT p_partkey, CAST(p_partkey % 2 AS INTEGER) AS k_fore, 41.2::double AS lat0, 2.4::double AS lon1, CAST(p_partkey AS INTEGER) AS n_hours, CAST(200 AS INTEGER) AS n_steps,
CAST(4 AS INTEGER) AS n_harmonics, CAST(400 AS INTEGER) AS iterations, CAST(p_size AS DOUBLE) / 100 AS learn_rate, CAST(6 AS INTEGER) AS depth, CAST(p_size AS INTEGER) AS min_weight FROM part""")
def _(s, d):
    named = v.table(s, d, "part").select(
        "p_partkey",
        F.expr("concat('cat_', p_partkey % 2, '_41.2,41.6_1.9,2.4_', p_partkey, '_200_4_400_', CAST(p_size AS DOUBLE) / 100, '_6_', p_size)").alias("name"),
    )
    parsed = keys.parse_model_name(named, "name")
    return parsed.select(
        "p_partkey", "k_fore", F.col("lat_range")[0].alias("lat0"), F.col("lon_range")[1].alias("lon1"), "n_hours", "n_steps",
        "n_harmonics", "iterations", "learn_rate", "depth", "min_weight",
    )


SUN_CTE = """, su0 AS (SELECT *, epoch_us(time) / 1000000.0::double + 1800 AS sec, radians(latitude) AS phi FROM sunin),
su1 AS (SELECT *, (sec - 946728000) / 86400 AS n, (sec / 3600) % 24 AS ut FROM su0),
su2 AS (SELECT *, radians(357.528::double + 0.9856003::double * n) AS g FROM su1),
su3 AS (SELECT *, radians(280.460::double + 0.9856474::double * n + 1.915::double * sin(g) + 0.020::double * sin(2 * g)) AS lam, radians(23.439::double - 0.0000004::double * n) AS eps FROM su2),
su4 AS (SELECT *, atan2(cos(eps) * sin(lam), cos(lam)) AS ra, asin(sin(eps) * sin(lam)) AS delta FROM su3),
su5 AS (SELECT *, radians(15 * (6.697375::double + 0.0657098242::double * n + ut) + longitude) - ra AS hh FROM su4),
su6 AS (SELECT *, degrees(asin(sin(delta) * sin(phi) + cos(delta) * cos(phi) * cos(hh))) AS sunElevation,
  degrees(atan2(-cos(delta) * sin(hh), sin(delta) * cos(phi) - cos(delta) * sin(phi) * cos(hh))) AS az FROM su5),
su7 AS (SELECT *, CASE WHEN az < 0 THEN az + 360 ELSE az END AS sunAzimuth, 90 - sunElevation - CASE WHEN sunElevation >= -0.8333667 THEN
  (1013.25::double / 1010) * (283 / (273 + airTemperature)) * 1.02::double / (60 * tan(radians(sunElevation + 10.3::double / (sunElevation + 5.11::double)))) ELSE 0 END AS zen FROM su6)"""
DISC_CTE = """, di1 AS (SELECT *, cos(radians(zen)) AS cz, 2 * pi() / 365 * (dayofyear(time + INTERVAL 30 MINUTE) - 1) AS dg FROM su7),
di2 AS (SELECT *, 1370 * (1.00011::double + 0.034221::double * cos(dg) + 0.00128::double * sin(dg) + 0.000719::double * cos(2 * dg) + 0.000077::double * sin(2 * dg)) AS i0 FROM di1),
di3 AS (SELECT *, least(1, greatest(0, GHI / (i0 * greatest(cz, 0.065::double)))) AS kt,
  least(12, 1 / (cz + 0.15::double * pow(greatest(93.885::double - zen, 1), -1.253::double))) AS m FROM di2),
di4 AS (SELECT *, CASE WHEN kt <= 0.6 THEN 0.512::double - 1.56::double * kt + 2.286::double * kt ** 2 - 2.222::double * kt ** 3 ELSE -5.743::double + 21.77::double * kt - 27.49::double * kt ** 2 + 11.56::double * kt ** 3 END AS a,
  CASE WHEN kt <= 0.6 THEN 0.37::double + 0.962::double * kt ELSE 41.4::double - 118.5::double * kt + 66.05::double * kt ** 2 + 31.9::double * kt ** 3 END AS b,
  CASE WHEN kt <= 0.6 THEN -0.28::double + 0.932::double * kt - 2.048::double * kt ** 2 ELSE -47.01::double + 184.2::double * kt - 222 * kt ** 2 + 73.81::double * kt ** 3 END AS c FROM di3),
di5 AS (SELECT *, i0 * (0.866::double - 0.122::double * m + 0.0121::double * m ** 2 - 0.000653::double * m ** 3 + 0.000014::double * m ** 4 - (a + b * exp(c * m))) AS raw_dni FROM di4),
di6 AS (SELECT *, CASE WHEN zen > 87 OR GHI < 0 OR raw_dni < 0 THEN 0 ELSE raw_dni END AS DNI FROM di5),
sun AS (SELECT *, GHI - DNI * cz AS DHI FROM di6)"""
SUNIN = v.WX + """, sunin AS (SELECT event_id, time, airTemperature, CAST(split_part(weatherStation, '_', 1) AS DOUBLE) AS latitude,
  CAST(split_part(weatherStation, '_', 2) AS DOUBLE) AS longitude, relativeHumidity * 1000 AS GHI FROM wx)"""


def _sunny(s, d):
    k = F.col("weatherStation")
    w = v.wx(s, d).withColumns({"latitude": keys.station_lat(k), "longitude": keys.station_lon(k), "GHI": F.col("relativeHumidity") * 1000})
    return solar.with_radiation(solar.sun_position(w))


@query("f11_sun_position", f"WITH {SUNIN}{SUN_CTE} SELECT event_id, round(sunAzimuth, 4) + 0.0::double AS sunAzimuth, round(sunElevation, 4) + 0.0::double AS sunElevation, round(zen, 4) + 0.0::double AS apparentZenith FROM su7")
def _(s, d):
    return _sunny(s, d).select("event_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("sunAzimuth", "sunElevation", "apparentZenith")])


@query("f12_direct_radiation", f"WITH {SUNIN}{SUN_CTE}{DISC_CTE} SELECT event_id, round(DNI, 3) + 0.0::double AS DNI FROM sun")
def _(s, d):
    return _sunny(s, d).select("event_id", (F.round("DNI", 3) + 0.0).alias("DNI"))


@query("f13_diffuse_radiation", f"WITH {SUNIN}{SUN_CTE}{DISC_CTE} SELECT event_id, round(DHI, 3) + 0.0::double AS DHI FROM sun")
def _(s, d):
    return _sunny(s, d).select("event_id", (F.round("DHI", 3) + 0.0).alias("DHI"))


@query("j4_radiation_joined_on_time", f"WITH {SUNIN}{SUN_CTE}{DISC_CTE} SELECT event_id, time, round(DNI, 3) + 0.0::double AS DNI, round(sunElevation, 4) + 0.0::double AS sunElevation, relativeHumidity FROM sun JOIN wx USING (event_id, time)")
def _(s, d):
    sun = _sunny(s, d).select("event_id", "time", (F.round("DNI", 3) + 0.0).alias("DNI"), (F.round("sunElevation", 4) + 0.0).alias("sunElevation"))
    return tables.join_variables([sun, v.wx(s, d).select("event_id", "time", "relativeHumidity")], ["event_id", "time"])


def sql_utm(lat: str, lon: str) -> tuple[str, str]:
    """Krueger series on GRS80, written with numbers of its own instead of those of the functions under test."""
    t = f"sinh(atanh(sin(radians({lat}))) - 0.08181919104281579::double * atanh(0.08181919104281579::double * sin(radians({lat}))))"
    dl = f"radians({lon} - 3)"
    xi, eta = f"atan({t} / cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + {t} ** 2))"
    alpha = ["0.0008377318229233356", "0.0000007608497033275728", "0.000000001203487805324186"]
    e = " + ".join([eta] + [f"{a}::double * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)])
    m = " + ".join([xi] + [f"{a}::double * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)])
    return f"(500000 + 6364902.16611274::double * ({e}))", f"(6364902.16611274::double * ({m}))"


UX, UY = sql_utm("lat", "lon")


@query("f14_to_utm", f"WITH {v.GRID} SELECT c_custkey, round({UX}, 3) AS x, round({UY}, 3) AS y FROM grid")
def _(s, d):
    xy = geo.with_utm(v.grid(s, d), "lat", "lon")
    return xy.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


A, B = sql_utm("lat + 0.05::double", "lon"), sql_utm("lat", "lon + 0.05::double")


@query("f15_bbox_to_utm", f"""WITH {v.GRID}, c AS (SELECT c_custkey, {A[0]} AS ax, {A[1]} AS ay, {B[0]} AS bx, {B[1]} AS b_y FROM grid)
SELECT c_custkey, round(least(ax, bx), 3) AS xmin, round(least(ay, b_y), 3) AS ymin, round(greatest(ax, bx), 3) AS xmax, round(greatest(ay, b_y), 3) AS ymax FROM c""")
def _(s, d):
    lat, lon = F.col("lat"), F.col("lon")
    box = geo.bbox_to_utm(lon, lat + 0.05, lon + 0.05, lat)
    return v.grid(s, d).select("c_custkey", *[F.round(box[c], 3).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query("f16_scale_vegetation", f"""WITH {v.RASTER} SELECT "row", col, CASE WHEN value * 1.2::double <= 200 THEN round(value * 1.2::double / 200 * 2 - 1, 6) + 0.0::double END AS value FROM raster""")
def _(s, d):
    return v.raster(s, d).withColumn("value", r6(weather.scale_vegetation(F.col("value") * 1.2)))


@query("f17_nodata_to_null", f"""WITH {v.RASTER} SELECT "row", col, nullif(value, 77) AS value FROM raster""")
def _(s, d):
    return v.raster(s, d).withColumn("value", weather.null_if(F.col("value"), 77))


@query("f18_quantile_scale", """SELECT event_id, round((value - user_id % 3) / nullif(event_id % 4 - user_id % 3, 0), 6) + 0.0::double AS scaled FROM events""")
def _(s, d):
    lo, hi = F.expr("user_id % 3"), F.expr("event_id % 4")
    return v.table(s, d, "events").select("event_id", r6(weather.quantile_scale(F.col("value"), lo, hi)).alias("scaled"))


@query("f19_quantile_unscale", """SELECT event_id, round(value * (event_id % 4 - user_id % 3) + user_id % 3, 6) + 0.0::double AS unscaled FROM events""")
def _(s, d):
    lo, hi = F.expr("user_id % 3"), F.expr("event_id % 4")
    return v.table(s, d, "events").select("event_id", r6(weather.quantile_unscale(F.col("value"), lo, hi)).alias("unscaled"))


@query("f20_to_percent", f"WITH {v.WX} SELECT event_id, round(relativeHumidity * 100, 6) + 0.0::double AS pct FROM wx")
def _(s, d):
    return v.wx(s, d).select("event_id", r6(weather.to_percent(F.col("relativeHumidity"))).alias("pct"))


@query("f21_cell_bounds", f"WITH {v.CELLS} SELECT cell, x - 50 AS x0, x + 50 AS x1, y - 50 AS y0, y + 50 AS y1, x - 100 AS cx0, y + 100 AS cy1 FROM cells")
def _(s, d):
    b = geo.cell_bounds(F.col("x"), F.col("y"), 100)
    c = geo.cell_bounds(F.col("x"), F.col("y"), 100, "circle")
    return v.cells(s, d).select("cell", b["x0"].alias("x0"), b["x1"].alias("x1"), b["y0"].alias("y0"), b["y1"].alias("y1"),
                                c["x0"].alias("cx0"), c["y1"].alias("cy1"))


@query("f22_euclid", f"WITH {v.GRID} SELECT c_custkey, round(sqrt((lat - 41.4::double) ** 2 + (lon - 2.1::double) ** 2), 6) + 0.0::double AS dist FROM grid")
def _(s, d):
    return v.grid(s, d).select("c_custkey", r6(geo.euclid(F.col("lat"), F.col("lon"), F.lit(41.4), F.lit(2.1))).alias("dist"))


@query("f24_issue_time", f"WITH {v.WX} SELECT event_id, date_trunc('day', time) + INTERVAL 1 HOUR AS forecastingTime FROM wx")
def _(s, d):
    return v.wx(s, d).select("event_id", clock.issue_time(F.col("time")).cast("timestamp_ntz").alias("forecastingTime"))


@query("f25_forecast_hours", """WITH i AS (SELECT DISTINCT CAST(ts AS DATE) AS issue FROM events)
SELECT CAST(issue AS VARCHAR) AS issue, unnest(generate_series(issue::timestamp + INTERVAL 1 HOUR, issue::timestamp + INTERVAL 4 DAY, INTERVAL 1 HOUR)) AS hour FROM i""")
def _(s, d):
    issues = v.table(s, d, "events").select(F.to_date("ts").alias("issue")).distinct()
    return issues.select(F.col("issue").cast("string").alias("issue"), F.explode(clock.forecast_hours(F.col("issue").cast("timestamp_ntz"))).alias("hour")).withColumn(
        "hour", F.col("hour").cast("timestamp_ntz")
    )
