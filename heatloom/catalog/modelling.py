"""Normalisation, features, splits, training, prediction and whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import model, order
from ..plans import downscale, harmonise, months
from ..session import scratch_path
from . import views as v
from .basics import DISC_CTE, SUN_CTE
from .registry import query, r6, rounded, sql_r6

VARS = ["airTemperature", "relativeHumidity"]
STATIONS = ["41.31_2.11", "41.32_2.12", "41.33_2.13", "41.34_2.14"]
STATS_SQL = """st AS (SELECT weatherStation, quantile_cont(airTemperature, 0.05) AS t0, quantile_cont(airTemperature, 0.95) AS t1,
  quantile_cont(relativeHumidity, 0.05) AS h0, quantile_cont(relativeHumidity, 0.95) AS h1 FROM wx GROUP BY 1)"""


def _hourly(s, d):
    """wx averaged to whole hours, so that every station can share times."""
    hour = F.date_trunc("hour", "time").cast("timestamp_ntz").alias("time")
    return v.wx(s, d).groupBy(hour, "weatherStation").agg(*[F.avg(c).alias(c) for c in VARS])


HOURLY = v.WX + """, hourly AS (SELECT date_trunc('hour', time) AS time, weatherStation, avg(airTemperature) AS airTemperature, avg(relativeHumidity) AS relativeHumidity FROM wx GROUP BY 1, 2)"""


def _cells(s, d):
    """A fine grid: nations as cells, named by coordinates."""
    n = v.table(s, d, "nation")
    return n.selectExpr("concat('41.', 300 + n_nationkey, '_2.', 100 + n_nationkey) AS weatherStation", "n_regionkey / 4.0D AS ndvi_mean", "n_nationkey / 24.0D AS elevation")


CELLS = """cellgrid AS (SELECT concat('41.', 300 + n_nationkey, '_2.', 100 + n_nationkey) AS weatherStation, n_regionkey / 4.0::double AS ndvi_mean, n_nationkey / 24.0::double AS elevation FROM nation)"""


@query("j15_normalise", f"""WITH {v.WX}, {STATS_SQL} SELECT event_id, round((airTemperature - t0) / (t1 - t0), 6) + 0.0::double AS airTemperature, round((relativeHumidity - h0) / (h1 - h0), 6) + 0.0::double AS relativeHumidity
FROM wx JOIN st USING (weatherStation)""")
def _(s, d):
    w = v.wx(s, d)
    return rounded(model.normalise(w, order.quantile_stats(w, VARS), VARS).select("event_id", *VARS), *VARS)


FEATURES = ", ".join(f"max({c}) FILTER (weatherStation = '{st}') AS {model.feature_name(c, st)}" for c in VARS for st in STATIONS)
FEATURE_NAMES = [model.feature_name(c, st) for c in VARS for st in STATIONS]


@query("j5_build_features", f"""WITH {HOURLY}, {CELLS}, wide AS (SELECT time, {FEATURES} FROM hourly GROUP BY time)
SELECT time, weatherStation, ndvi_mean, round(elevation, 6) AS elevation, {', '.join(f'coalesce(round({f}, 6), -99) AS {f}' for f in FEATURE_NAMES)},
 round(sin(2 * pi() * hour(time) / 24), 6) + 0.0::double AS hour_1_sin, CAST(split_part(weatherStation, '_', 1) AS DOUBLE) AS latitude FROM wide, cellgrid""")
def _(s, d):
    lr, static = _hourly(s, d), _cells(s, d)
    f = model.grid_features(lr, static, VARS, STATIONS, 1)
    out = f.select(
        "time", "weatherStation", "ndvi_mean", r6("elevation").alias("elevation"),
        *[F.coalesce(F.round(c, 6), F.lit(-99.0)).alias(c) for c in FEATURE_NAMES], r6("hour_1_sin").alias("hour_1_sin"), "latitude",
    )
    return out


@query("j5_features_of_runs", f"""WITH {HOURLY}, {CELLS}, i AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-09', TIMESTAMP '2024-01-12', INTERVAL 1 DAY)) AS issue),
 runs AS (SELECT issue + INTERVAL 1 HOUR AS forecastingTime, hourly.* FROM hourly JOIN i ON time BETWEEN issue + INTERVAL 1 HOUR AND issue + INTERVAL 4 DAY),
 wide AS (SELECT forecastingTime, time, {FEATURES} FROM runs GROUP BY 1, 2)
SELECT forecastingTime, time, weatherStation, round(elevation, 6) AS elevation, {', '.join(f'coalesce(round({f}, 6), -99) AS {f}' for f in FEATURE_NAMES)} FROM wide, cellgrid""")
def _(s, d):
    runs = model.forecast_runs(_hourly(s, d), "2024-01-12", 3)
    f = model.grid_features(runs, _cells(s, d), VARS, STATIONS, 1, run=["forecastingTime"])
    return f.select("forecastingTime", "time", "weatherStation", r6("elevation").alias("elevation"), *[F.coalesce(F.round(c, 6), F.lit(-99.0)).alias(c) for c in FEATURE_NAMES])


@query("m2_split_by_time", """WITH t AS (SELECT DISTINCT ts AS time FROM events), r AS (
  SELECT time, row_number() OVER (ORDER BY md5(concat(strftime(time, '%Y-%m-%d %H:%M:%S.%f'), '|42')), time) AS r, count(*) OVER () AS n FROM t)
SELECT event_id, r <= ceil(0.1::double * n) AS is_test FROM events JOIN r ON ts = time""")
def _(s, d):
    return model.split_by_time(v.wx(s, d), 0.1).select("event_id", "is_test")


@query("m5_assemble_predictions", f"""WITH {v.WX}, {STATS_SQL} SELECT time, weatherStation, round(relativeHumidity * (t1 - t0) + t0, 6) + 0.0::double AS airTemperature,
 round((event_id % 10) / 10.0::double * (h1 - h0) + h0, 6) + 0.0::double AS relativeHumidity FROM wx JOIN st USING (weatherStation)""")
def _(s, d):
    w = v.wx(s, d)
    pred = w.selectExpr("time", "weatherStation", "relativeHumidity AS pred_airTemperature", "(event_id % 10) / 10.0D AS pred_relativeHumidity")
    return rounded(model.assemble_predictions(pred, order.quantile_stats(w, VARS)), *VARS)


@query("m6_forecast_runs", """WITH i AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-09', TIMESTAMP '2024-01-12', INTERVAL 1 DAY)) AS issue)
SELECT event_id, ts AS time, issue + INTERVAL 1 HOUR AS forecastingTime FROM events JOIN i ON date_trunc('hour', ts) BETWEEN issue + INTERVAL 1 HOUR AND issue + INTERVAL 4 DAY""")
def _(s, d):
    return model.forecast_runs(v.wx(s, d), "2024-01-12", 3).select("event_id", "time", "forecastingTime")


@query("f8_model_features_of_month", f"""WITH {v.MONTHLY} SELECT o_orderkey, round(sin(2 * pi() * 2 * month(time) / 12), 6) + 0.0::double AS month_2_sin, round(cos(2 * pi() * month(time) / 12), 6) + 0.0::double AS month_1_cos FROM monthly""")
def _(s, d):
    return rounded(clock.fourier(v.monthly(s, d), "time", 2).select("o_orderkey", "month_2_sin", "month_1_cos"), "month_2_sin", "month_1_cos")


def _training(s, d):
    """Fine-grid truth made from the coarse hours plus an offset per cell."""
    lr, static = _hourly(s, d), _cells(s, d)
    offset = F.col("elevation") * 3 - F.col("ndvi_mean")
    near = static.withColumn("_s", F.element_at(F.array(*[F.lit(x) for x in STATIONS]), F.expr("CAST(elevation * 24 AS INT) % 4 + 1")))
    hr = lr.withColumnRenamed("weatherStation", "_s").join(near, "_s").select(
        "time", "weatherStation", (F.col("airTemperature") + offset).alias("airTemperature"), "relativeHumidity"
    )
    return hr, lr, static


# All settings as documented but for the rounds: 400 of them take minutes at any size.
PARAMS = {"iterations": 40}


TRUTH = """truth AS (SELECT h.time, c.weatherStation, h.airTemperature + (c.elevation * 3 - c.ndvi_mean) AS a, h.relativeHumidity AS r, c.ndvi_mean, c.elevation FROM hourly h
 JOIN (SELECT *, concat('41.', 31 + n % 4, '_2.', 11 + n % 4) AS near FROM (SELECT *, CAST(split_part(split_part(weatherStation, '_', 1), '.', 2) AS INTEGER) - 300 AS n FROM cellgrid)) c ON c.near = h.weatherStation),
ys AS (SELECT weatherStation, quantile_cont(a, 0.05) AS a0, quantile_cont(a, 0.95) AS a1, quantile_cont(r, 0.05) AS r0, quantile_cont(r, 0.95) AS r1 FROM truth GROUP BY 1),
xs AS (SELECT weatherStation, quantile_cont(airTemperature, 0.05) AS a0, quantile_cont(airTemperature, 0.95) AS a1, quantile_cont(relativeHumidity, 0.05) AS r0, quantile_cont(relativeHumidity, 0.95) AS r1 FROM hourly GROUP BY 1),
nx AS (SELECT time, weatherStation, (airTemperature - a0) / (a1 - a0) AS airTemperature, (relativeHumidity - r0) / (r1 - r0) AS relativeHumidity FROM hourly JOIN xs USING (weatherStation))"""


@query("m1_prepare_training", f"""WITH {HOURLY}, {CELLS}, {TRUTH}, wide AS (SELECT time, {FEATURES} FROM nx GROUP BY time)
SELECT time, weatherStation, round((a - a0) / (a1 - a0), 6) + 0.0::double AS y_airTemperature, round((r - r0) / (r1 - r0), 6) + 0.0::double AS y_relativeHumidity, ndvi_mean,
 {', '.join(f'coalesce(round({f}, 6), -99) + 0.0::double AS {f}' for f in FEATURE_NAMES)} FROM truth JOIN ys USING (weatherStation) JOIN wide USING (time)""")
def _(s, d):
    hr, lr, static = _training(s, d)
    rows, _, _ = model.prepare_training(hr, lr, static, VARS, STATIONS, n_harmonics=2)
    out = rounded(rows, "y_airTemperature", "y_relativeHumidity")
    return out.select("time", "weatherStation", "y_airTemperature", "y_relativeHumidity", "ndvi_mean",
                      *[(F.coalesce(F.round(c, 6), F.lit(-99.0)) + 0.0).alias(c) for c in FEATURE_NAMES])


@query("m3_train")
def _(s, d):
    hr, lr, static = _training(s, d)
    hours = downscale.training_hours(hr, lr)
    _, errors, _, _ = downscale.fit_downscaling(hr, lr, static, VARS, STATIONS, PARAMS, hours, validation_hours=50)
    return errors


@query("m4_predict")
def _(s, d):
    hr, lr, static = _training(s, d)
    hours = downscale.training_hours(hr, lr)
    fitted, _, lr_stats, hr_stats = downscale.fit_downscaling(hr, lr, static, VARS, STATIONS, PARAMS, hours, validation_hours=50)
    return downscale.predict_grid(fitted, lr, static, lr_stats, hr_stats, VARS, STATIONS).select("time", "weatherStation", *VARS)


# Written out, so that a changed list in the flows shows.
FORECAST_SMOOTH = ["windSpeed", "windSpeedEast", "windSpeedNorth", "windDirection", "airTemperature", "relativeHumidity"]
HIST_MEANS = [*FORECAST_SMOOTH, "dewAirTemperature", "soilTemperature", "soilWaterRatio", "lowVegetationRatio", "highVegetationRatio", "albedo"]


def _hist_sql(raw: str = v.RAW) -> str:
    w = "OVER (PARTITION BY weatherStation ORDER BY time)"
    named = "u10 AS windSpeedEast, v10 AS windSpeedNorth, lai_lv AS lowVegetationRatio, lai_hv AS highVegetationRatio, tp AS totalPrecipitation, ssrd AS GHI, fal AS albedo, swvl4 AS soilWaterRatio"
    kelvin = "t2m - 273.15::double AS airTemperature, d2m - 273.15::double AS dewAirTemperature, stl4 - 273.15::double AS soilTemperature"
    means = ", ".join(f"CASE WHEN lead(event_id) {w} IS NULL THEN {c} ELSE (lead({c}) {w} + {c}) / 2 END AS {c}" for c in HIST_MEANS)
    return f"""WITH {raw}, a AS (SELECT event_id, valid_time AS time, concat(latitude, '_', longitude) AS weatherStation, latitude, longitude, {named}, {kelvin},
 sqrt(u10 ** 2 + v10 ** 2) AS windSpeed, (180 + degrees(atan2(u10, v10))) % 360 AS windDirection FROM raw),
b AS (SELECT *, exp(17.67::double * dewAirTemperature / (dewAirTemperature + 243.5::double)) / exp(17.67::double * airTemperature / (airTemperature + 243.5::double)) AS relativeHumidity FROM a),
c AS (SELECT event_id, time, weatherStation, latitude, longitude, {means},
 CASE WHEN lag(event_id) {w} IS NOT NULL AND lead(GHI) {w} - GHI > 0 THEN (lead(GHI) {w} - GHI) / 3600 ELSE 0 END AS GHI,
 CASE WHEN lag(event_id) {w} IS NULL THEN 0 WHEN lead(event_id) {w} IS NULL THEN totalPrecipitation - lag(totalPrecipitation) {w} ELSE (lead(totalPrecipitation) {w} - totalPrecipitation) * 1000 END AS rain FROM b),
e AS (SELECT * EXCLUDE (rain), CASE WHEN rain >= 0 THEN rain ELSE lag(rain) {w} END AS totalPrecipitation FROM c),
sunin AS (SELECT * FROM e){SUN_CTE}{DISC_CTE}"""


HIST_OUT = [c for c in HIST_MEANS if c != "windDirection"] + ["GHI", "totalPrecipitation"]


@query("m8_history_weather", f"{_hist_sql()} SELECT event_id, weatherStation, time, {', '.join(f'round({c}, 5) + 0.0::double AS {c}' for c in HIST_OUT + ['windDirection'])}, round(sunElevation, 4) + 0.0::double AS sunElevation, round(sunAzimuth, 4) + 0.0::double AS sunAzimuth, round(DNI, 3) + 0.0::double AS DNI, round(DHI, 3) + 0.0::double AS DHI FROM sun")
def _(s, d):
    out = harmonise.history_weather(v.raw(s, d))
    five = {c: F.round(c, 5) + 0.0 for c in HIST_OUT + ["windDirection"]}
    four = {c: F.round(c, 4) + 0.0 for c in ("sunElevation", "sunAzimuth")}
    three = {c: F.round(c, 3) + 0.0 for c in ("DNI", "DHI")}
    return out.withColumns(five | four | three).select("event_id", "weatherStation", "time", *five, *four, *three)


ALL_MONTHS = (199501, 200112)


@query("m8_fill_months", f"{_hist_sql(v.DAYS)} SELECT event_id, weatherStation, time, {', '.join(f'round({c}, 5) + 0.0::double AS {c}' for c in HIST_OUT + ['windDirection'])}, round(DNI, 3) + 0.0::double AS DNI, round(DHI, 3) + 0.0::double AS DHI FROM sun")
def _(s, d):
    """First a part of the months, then all but a hole, then everything, as history comes in."""
    root = scratch_path(s, "filled")
    raw = v.raw_days(s, d)
    for there in ("valid_time < '1996-03-01'", "year(valid_time) * 100 + month(valid_time) NOT BETWEEN 199705 AND 199707", "true"):
        months.fill_months(raw.where(there), root, *ALL_MONTHS, months_per_commit=80)
    five = {c: F.round(c, 5) + 0.0 for c in HIST_OUT + ["windDirection"]}
    three = {c: F.round(c, 3) + 0.0 for c in ("DNI", "DHI")}
    return months.read_filled(s, root, *ALL_MONTHS).withColumns(five | three).select("event_id", "weatherStation", "time", *five, *three)


FINE_CELLS = """cellgrid AS (SELECT concat('41.', 300 + n_nationkey, '_2.', 100 + n_nationkey) AS weatherStation, CASE WHEN n_nationkey % 2 = 0 THEN '41.2_2.1' ELSE '41.3_2.1' END AS near, n_nationkey * 20.0::double AS elevation FROM nation)"""


@query("m4_predict_months", f"{_hist_sql(v.DAYS)}, {FINE_CELLS} SELECT time, cellgrid.weatherStation, CAST(year(time) * 100 + month(time) AS INTEGER) AS ym, round(airTemperature - elevation * 0.0065::double, 5) + 0.0::double AS airTemperature, round(relativeHumidity, 5) + 0.0::double AS relativeHumidity FROM sun JOIN cellgrid ON sun.weatherStation = near")
def _(s, d):
    """Months are predicted, then history comes in, then only new and changed months are predicted."""
    weather, root = scratch_path(s, "filled"), scratch_path(s, "predicted")
    cells = v.table(s, d, "nation").selectExpr("concat('41.', 300 + n_nationkey, '_2.', 100 + n_nationkey) AS weatherStation", "CASE WHEN n_nationkey % 2 = 0 THEN '41.2_2.1' ELSE '41.3_2.1' END AS near", "n_nationkey * 20.0D AS elevation")

    def score(rows):
        return downscale.station_baseline(rows, cells)

    raw = v.raw_days(s, d)
    for there in ("valid_time < '1996-03-01'", "true"):
        months.fill_months(raw.where(there), weather, *ALL_MONTHS, months_per_commit=80)
        months.predict_months(s, weather, root, *ALL_MONTHS, score, months_per_write=40)
    out = s.read.parquet(root)
    return out.select("time", "weatherStation", "ym", *[(F.round(c, 5) + 0.0).alias(c) for c in VARS])


W = "OVER (PARTITION BY weatherStation ORDER BY time)"
FORE_MEANS = ", ".join(f"CASE WHEN lead(event_id) {W} IS NULL THEN {c} ELSE (lead({c}) {W} + {c}) / 2 END AS {c}" for c in FORECAST_SMOOTH)


@query("m8_forecast_weather", f"""WITH {v.RAW}, a AS (SELECT event_id, valid_time AS time, concat(latitude, '_', longitude) AS weatherStation, latitude, longitude, u10 AS windSpeedEast, v10 AS windSpeedNorth,
 t2m - 273.15::double AS airTemperature, fal AS relativeHumidity, tp AS totalPrecipitation, value_ghi AS GHI, sqrt(u10 ** 2 + v10 ** 2) AS windSpeed, (180 + degrees(atan2(u10, v10))) % 360 AS windDirection
 FROM (SELECT *, ssrd / 3600 AS value_ghi FROM raw)), sunin AS (SELECT event_id, time, weatherStation, latitude, longitude, {FORE_MEANS}, totalPrecipitation, GHI FROM a){SUN_CTE}{DISC_CTE}
SELECT event_id, weatherStation, {', '.join(f'round({c}, 5) + 0.0::double AS {c}' for c in FORECAST_SMOOTH)}, round(totalPrecipitation, 6) AS totalPrecipitation, round(DNI, 3) + 0.0::double AS DNI, round(DHI, 3) + 0.0::double AS DHI FROM sun""")
def _(s, d):
    raw = v.raw(s, d).selectExpr(
        "event_id", "valid_time AS time", "latitude AS lat", "longitude AS lon", "u10 AS u", "v10 AS v", "t2m AS temp", "fal AS rh", "tp AS prec", "ssrd / 3600 AS swflx"
    )
    out = harmonise.forecast_weather(raw)
    five = {c: F.round(c, 5) + 0.0 for c in FORECAST_SMOOTH}
    three = {c: F.round(c, 3) + 0.0 for c in ("DNI", "DHI")}
    return out.withColumns(five | three | {"totalPrecipitation": F.round("totalPrecipitation", 6)}).select(
        "event_id", "weatherStation", *five, "totalPrecipitation", *three
    )


RW = "OVER (PARTITION BY weatherStation, issue ORDER BY time)"
RUN_MEANS = ", ".join(f"CASE WHEN lead(event_id) {RW} IS NULL THEN {c} ELSE (lead({c}) {RW} + {c}) / 2 END AS {c}" for c in VARS)


@query("m6_forecast_flow", f"""WITH {v.RAW}, i AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12', INTERVAL 1 DAY)) AS issue),
a AS (SELECT event_id, issue, valid_time AS time, concat(latitude, '_', longitude) AS weatherStation, t2m - 273.15::double + day(issue) / 10.0::double AS airTemperature, fal AS relativeHumidity
 FROM raw JOIN i ON valid_time >= issue AND valid_time < issue + INTERVAL 5 DAY WHERE latitude > 41.15 AND latitude < 41.45 AND longitude > 1.85 AND longitude < 2.35),
b AS (SELECT issue, time, weatherStation, {RUN_MEANS} FROM a)
SELECT issue + INTERVAL 1 HOUR AS "forecastingTime", time, concat('41.', 300 + n_nationkey, '_2.', 100 + n_nationkey) AS weatherStation, '2024-01-12' AS predicted,
 round(airTemperature - n_nationkey * 20.0::double * 0.0065::double, 5) + 0.0::double AS airTemperature, round(relativeHumidity, 5) + 0.0::double AS relativeHumidity
FROM b JOIN nation ON weatherStation = concat(round(41.2::double + 0.1::double * (n_nationkey % 3), 1), '_', round(1.9::double + 0.1::double * (n_nationkey % 5), 1))
WHERE date_trunc('hour', time) BETWEEN issue + INTERVAL 1 HOUR AND issue + INTERVAL 4 DAY""")
def _(s, d):
    """Runs of three days, each of which says something else, to stored predictions on the cells of a box."""
    issues = s.range(3).selectExpr("timestamp_ntz'2024-01-10' + make_dt_interval(CAST(id AS INT)) AS issued")
    raw = v.raw(s, d).selectExpr(
        "event_id", "valid_time AS time", "latitude AS lat", "longitude AS lon", "u10 AS u", "v10 AS v", "t2m AS temp", "fal AS rh", "tp AS prec", "ssrd / 3600 AS swflx"
    )
    raw = raw.withColumn("issued", F.explode(F.lit([0, 1, 2, 3, 4]))).selectExpr("* EXCEPT (issued)", "CAST(date_trunc('day', time) - make_dt_interval(issued) AS TIMESTAMP_NTZ) AS issued")
    raw = raw.join(issues, "issued").withColumn("temp", F.col("temp") + F.day("issued") / 10.0)
    rows = months.forecast_rows(raw, "2024-01-12", 2, (41.15, 41.45, 1.85, 2.35))
    cells = v.table(s, d, "nation").selectExpr(
        "concat('41.', 300 + n_nationkey, '_2.', 100 + n_nationkey) AS weatherStation",
        "concat(round(41.2D + 0.1D * (n_nationkey % 3), 1), '_', round(1.9D + 0.1D * (n_nationkey % 5), 1)) AS near", "n_nationkey * 20.0D AS elevation",
    )
    root = scratch_path(s, "forecast")
    months.write_forecast(downscale.station_baseline(rows, cells, run=["forecastingTime"]), root, "2024-01-12")
    out = s.read.parquet(root)
    return out.select("forecastingTime", "time", "weatherStation", F.date_format("predicted", "yyyy-MM-dd").alias("predicted"), *[(F.round(c, 5) + 0.0).alias(c) for c in VARS])
