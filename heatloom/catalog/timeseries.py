"""Windows, set operations, order and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, dedup, model, order, series, tables
from ..operators.neighbours import mark_ends
from . import views as v
from .registry import query, r6, rounded, sql_r6

BATCH = "(dayofyear(time) - 1) // 7"
W = "OVER (PARTITION BY weatherStation ORDER BY time)"
WB = "OVER (PARTITION BY weatherStation, batch ORDER BY time)"
RAW_KEY = "concat(latitude, '_', longitude)"


def _raw_series(s, d):
    return v.raw(s, d).select(
        "event_id", F.col("valid_time").alias("time"), F.expr(RAW_KEY).alias("weatherStation"),
        F.col("tp").alias("totalPrecipitation"), F.col("ssrd").alias("GHI"),
    )


RAW_SERIES = v.RAW + f""", s AS (
  SELECT event_id, valid_time AS time, {RAW_KEY} AS weatherStation, tp AS totalPrecipitation, ssrd AS GHI FROM raw)"""


@query("w1_interval_mean", f"""WITH {v.WX}, n AS (
  SELECT event_id, weatherStation, airTemperature AS a, relativeHumidity AS h, lead(airTemperature) {W} AS na,
         lead(relativeHumidity) {W} AS nh, lead(event_id) {W} AS nx FROM wx)
SELECT event_id, weatherStation, round(CASE WHEN nx IS NULL THEN a ELSE (na + a) / 2 END, 6) + 0.0::double AS airTemperature,
       round(CASE WHEN nx IS NULL THEN h ELSE (nh + h) / 2 END, 6) + 0.0::double AS relativeHumidity FROM n""")
def _(s, d):
    out = series.interval_mean(v.wx(s, d), ["airTemperature", "relativeHumidity"])
    return rounded(out.drop("time"), "airTemperature", "relativeHumidity")


@query("w1_interval_mean_by_batch", f"""WITH {v.WX}, b AS (SELECT *, {BATCH} AS batch FROM wx), n AS (
  SELECT event_id, weatherStation, airTemperature AS a, lead(airTemperature) {WB} AS na, lead(event_id) {WB} AS nx FROM b)
SELECT event_id, weatherStation, round(CASE WHEN nx IS NULL THEN a ELSE (na + a) / 2 END, 6) + 0.0::double AS airTemperature FROM n""")
def _(s, d):
    weekly = v.wx(s, d).withColumn("batch", F.expr("(dayofyear(time) - 1) div 7"))
    out = series.interval_mean(weekly, ["airTemperature"], batch_col="batch")
    return rounded(out.select("event_id", "weatherStation", "airTemperature"), "airTemperature")


@query("w1_interval_mean_circular", f"""WITH {v.WX}, b AS (SELECT event_id, weatherStation, time, (event_id * 37) % 360 AS dir FROM wx), n AS (
  SELECT event_id, weatherStation, dir, lead(dir) {W} AS nd FROM b), m AS (
  SELECT event_id, weatherStation, CASE WHEN nd IS NULL THEN dir ELSE
    degrees(atan2(sin(radians(dir)) + sin(radians(nd)), cos(radians(dir)) + cos(radians(nd)))) END AS x FROM n)
SELECT event_id, weatherStation, round(CASE WHEN x < 0 THEN x + 360 ELSE x END, 4) % 360 + 0.0::double AS dir FROM m""")
def _(s, d):
    directed = v.wx(s, d).withColumn("dir", F.expr("CAST((event_id * 37) % 360 AS DOUBLE)"))
    out = series.interval_mean(directed, ["dir"], circular=["dir"])
    return out.select("event_id", "weatherStation", (F.round("dir", 4) % 360 + 0.0).alias("dir"))


@query("w2_deaccumulate_radiation", f"""WITH {RAW_SERIES}, n AS (
  SELECT event_id, GHI, lag(event_id) {W} AS p, lead(event_id) {W} AS nx, (lead(GHI) {W} - GHI) / 3600 AS f FROM s)
SELECT event_id, round(CASE WHEN p IS NOT NULL AND nx IS NOT NULL AND f > 0 THEN f ELSE 0 END, 6) + 0.0::double AS GHI FROM n""")
def _(s, d):
    return rounded(series.deaccumulate_radiation(_raw_series(s, d)).select("event_id", "GHI"), "GHI")


@query("w3_deaccumulate_rain", f"""WITH {RAW_SERIES}, n AS (
  SELECT event_id, weatherStation, time, totalPrecipitation AS c, lag(totalPrecipitation) {W} AS p, lead(totalPrecipitation) {W} AS x FROM s), r AS (
  SELECT *, CASE WHEN p IS NULL THEN 0 WHEN x IS NULL THEN c - p ELSE (x - c) * 1000 END AS rain FROM n), q AS (
  SELECT *, lag(rain) {W} AS before FROM r)
SELECT event_id, round(CASE WHEN rain >= 0 THEN rain ELSE before END, 6) + 0.0::double AS rain FROM q""")
def _(s, d):
    out = series.deaccumulate_rain(_raw_series(s, d))
    return out.select("event_id", r6("totalPrecipitation").alias("rain"))


@query("w4_repair_negative_rain_by_batch", f"""WITH {RAW_SERIES}, b AS (SELECT *, {BATCH} AS batch FROM s), n AS (
  SELECT event_id, weatherStation, batch, time, totalPrecipitation AS c, lag(totalPrecipitation) {WB} AS p, lead(totalPrecipitation) {WB} AS x FROM b), r AS (
  SELECT *, CASE WHEN p IS NULL THEN 0 WHEN x IS NULL THEN (c - p) * 1000 ELSE (x - c) * 1000 END AS rain FROM n), q AS (
  SELECT *, lag(rain) {WB} AS before FROM r)
SELECT event_id, round(CASE WHEN rain >= 0 THEN rain ELSE before END, 6) + 0.0::double AS rain FROM q""")
def _(s, d):
    weekly = _raw_series(s, d).withColumn("batch", F.expr("(dayofyear(time) - 1) div 7"))
    out = series.deaccumulate_rain(weekly, batch_col="batch", fix_last_unit=True)
    return out.select("event_id", r6("totalPrecipitation").alias("rain"))


@query("w5_rolling_min", f"""WITH {v.WX}, dly AS (
  SELECT weatherStation, CAST(time AS DATE) AS date, max(airTemperature) AS m FROM wx GROUP BY 1, 2)
SELECT weatherStation, CAST(date AS VARCHAR) AS date, round(min(m) OVER (PARTITION BY weatherStation ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) + 0.0::double AS low FROM dly""")
def _(s, d):
    daily = v.wx(s, d).groupBy("weatherStation", F.to_date("time").alias("date")).agg(F.max("airTemperature").alias("m"))
    return rounded(series.rolling_min(daily, "m", 3, time="date", alias="low").drop("m").withColumn("date", F.col("date").cast("string")), "low")


@query("w6_rank_of_many_zeros", """WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 = 0 THEN l_extendedprice ELSE 0.0::double END AS price, CASE WHEN l_orderkey % 3 > 0 THEN l_discount END AS discount FROM lineitem), t AS (SELECT count(*) AS n FROM x)
SELECT l_orderkey, l_linenumber, round(count(price) OVER (ORDER BY price RANGE UNBOUNDED PRECEDING) / (n - 1)::double, 6) AS price_percentile,
 CASE WHEN discount IS NULL THEN 0 ELSE round(sum(CASE WHEN discount IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY discount NULLS FIRST RANGE UNBOUNDED PRECEDING) / (n - 1)::double, 6) END AS discount_percentile FROM x, t""")
def _(s, d):
    """A column of nine zeros in ten, and one of few values and nulls."""
    x = v.table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 10 = 0 THEN l_extendedprice ELSE 0D END AS price", "CASE WHEN l_orderkey % 3 > 0 THEN l_discount END AS discount")
    return rounded(order.ecdf_rank(x, ["price", "discount"], ["l_orderkey", "l_linenumber"]), "price_percentile", "discount_percentile")


@query("w6_ecdf_rank", f"""WITH {v.CELLS}, x AS (SELECT p_partkey AS cell, p_size AS a, p_retailprice AS b FROM part), t AS (SELECT count(*) AS n FROM x)
SELECT cell, round(count(*) OVER (ORDER BY a RANGE UNBOUNDED PRECEDING) / (n - 1), 6) AS a_percentile,
       round(count(*) OVER (ORDER BY b RANGE UNBOUNDED PRECEDING) / (n - 1), 6) AS b_percentile, 0.0::double AS c_percentile FROM x, t""")
def _(s, d):
    x = v.table(s, d, "part").selectExpr("p_partkey AS cell", "p_size AS a", "p_retailprice AS b", "7 AS c")
    return rounded(order.ecdf_rank(x, ["a", "b", "c"], ["cell"]), "a_percentile", "b_percentile", "c_percentile")


@query("w7_dedup_keep_last", f"""WITH {v.OBS} SELECT obs_key, seq, station_id, datetime, value FROM obs
QUALIFY row_number() OVER (PARTITION BY obs_key ORDER BY seq DESC) = 1""")
def _(s, d):
    return dedup.dedup_keep_last(v.obs(s, d), ["obs_key"], ["seq"])


@query("w8_dedup_keep_first", f"""WITH {v.OBS} SELECT obs_key, seq, station_id, datetime, value FROM obs
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY value, seq) = 1""")
def _(s, d):
    return dedup.dedup_keep_first(v.obs(s, d), ["station_id"], ["value", "seq"])


@query("w9_first_last_rows", f"""WITH {v.WX} SELECT event_id, lag(event_id) {W} IS NULL AS is_first, lead(event_id) {W} IS NULL AS is_last FROM wx""")
def _(s, d):
    return mark_ends(v.wx(s, d), ["weatherStation"], "time").select("event_id", "is_first", "is_last")


@query("o1_row_order_in_series", f"""WITH {v.WX} SELECT event_id, coalesce(lag(event_id) {W}, -1) AS before, coalesce(lead(event_id) {W}, -1) AS after FROM wx""")
def _(s, d):
    from ..operators.neighbours import with_neighbours

    n = with_neighbours(v.wx(s, d), ["weatherStation"], "time", ["event_id"])
    return n.select("event_id", F.coalesce("_prev_event_id", F.lit(-1)).alias("before"),
                    F.coalesce("_next_event_id", F.lit(-1)).alias("after"))


@query("o2_sorted_daily", f"""WITH {v.WX} SELECT weatherStation, CAST(CAST(time AS DATE) AS VARCHAR) AS date, round(max(airTemperature), 6) + 0.0::double AS top
FROM wx GROUP BY 1, 2 ORDER BY 1, 2""")
def _(s, d):
    daily = v.wx(s, d).groupBy("weatherStation", F.to_date("time").cast("string").alias("date")).agg(r6(F.max("airTemperature")).alias("top"))
    return daily.orderBy("weatherStation", "date")


@query("o3_sorted_for_write", f"""WITH {v.OBS} SELECT station_id, datetime, seq FROM obs ORDER BY station_id, datetime""")
def _(s, d):
    return v.obs(s, d).select("station_id", "datetime", "seq").sortWithinPartitions("station_id", "datetime")


SEEDED = "md5(concat(strftime(time, '%Y-%m-%d %H:%M:%S.%f'), '|42'))"


@query("o5_chunk_times", f"""WITH t AS (SELECT DISTINCT ts AS time FROM events), f AS (SELECT time FROM t ORDER BY time LIMIT 700), r AS (
  SELECT time, row_number() OVER (ORDER BY {SEEDED}, time) AS r FROM f)
SELECT time, CAST(least((r - 1) // 88, 7) AS BIGINT) AS chunk FROM r""")
def _(s, d):
    return model.chunk_times(v.wx(s, d), 700, 8)


@query("o7_sample_times", f"""WITH t AS (SELECT DISTINCT ts AS time FROM events)
SELECT time FROM t ORDER BY {SEEDED}, time LIMIT 500""")
def _(s, d):
    return model.sample_times(v.wx(s, d), 500)


@query("u1_union_all", f"""WITH {v.WX} SELECT weatherStation, count(*) AS n, round(sum(airTemperature), 4) AS total FROM (
  SELECT * FROM wx UNION ALL SELECT * FROM wx WHERE relativeHumidity > 0.5) GROUP BY 1""")
def _(s, d):
    w = v.wx(s, d)
    both = tables.union_all(w, w.where("relativeHumidity > 0.5"))
    return both.groupBy("weatherStation").agg(F.count("*").alias("n"), F.round(F.sum("airTemperature"), 4).alias("total"))


@query("u2_common_times", """SELECT date_trunc('day', ts) AS time FROM events WHERE value > 20 INTERSECT
SELECT date_trunc('day', ts) FROM events WHERE event_type = 'error'""")
def _(s, d):
    e = v.table(s, d, "events").withColumn("time", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return tables.common_times(e.where("value > 20"), e.where("event_type = 'error'"))


@query("u3_distinct_rows", f"""WITH {v.MONTHLY} SELECT DISTINCT weatherStation, airTemperature FROM monthly""")
def _(s, d):
    return tables.distinct_values(v.monthly(s, d), "weatherStation", "airTemperature")


UPSERT = f"""WITH {v.OBS}, b AS (SELECT obs_key, seq, station_id, datetime, value, 0 AS side FROM obs WHERE event_old
  UNION ALL SELECT obs_key, seq, station_id, datetime, value + 1, 1 FROM obs WHERE event_new)
SELECT obs_key, seq, station_id, datetime, value FROM b QUALIFY row_number() OVER (PARTITION BY obs_key ORDER BY side DESC, seq DESC) = 1"""
OLD, NEW = "value < 60", "seq % 3 = 0"


@query("s17_upsert_keep_last", UPSERT.replace("event_old", OLD).replace("event_new", NEW))
def _(s, d):
    o = v.obs(s, d)
    new = o.where(NEW).withColumn("value", F.col("value") + 1)
    return dedup.upsert_keep_last(o.where(OLD), new, ["obs_key"], ["seq"])


@query("u4_merge_existing_and_new", f"""WITH {v.OBS}, b AS (SELECT station_id, CAST(datetime AS DATE) AS date, value, seq, CASE WHEN {NEW} THEN 1 ELSE 0 END AS side FROM obs)
SELECT station_id, CAST(date AS VARCHAR) AS date, value, seq FROM b QUALIFY row_number() OVER (PARTITION BY station_id, date ORDER BY side DESC, seq DESC) = 1""")
def _(s, d):
    o = v.obs(s, d).select("station_id", F.to_date("datetime").alias("date"), "value", "seq")
    merged = dedup.upsert_keep_last(o.where(f"NOT ({NEW})"), o.where(NEW), ["station_id", "date"], ["seq"])
    return merged.withColumn("date", F.col("date").cast("string"))


@query("j9_nearest_time", f"""WITH {v.WX}, m AS (SELECT arg_min(time, (abs(epoch_us(time) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), time)) AS t FROM wx)
SELECT event_id, weatherStation, {sql_r6('airTemperature')} FROM wx, m WHERE time = t""")
def _(s, d):
    near = series.nearest_time(v.wx(s, d), "2024-01-15 12:00:00")
    return rounded(near.select("event_id", "weatherStation", "airTemperature"), "airTemperature")


# Every odd event looks for even events of its station; of equal times the greatest event counts.
ASKED = """asked AS (SELECT event_id, weatherStation, time FROM wx WHERE event_id % 2 = 1),
known AS (SELECT weatherStation, time, max(event_id) AS found, arg_max(airTemperature, event_id) AS t FROM wx WHERE event_id % 2 = 0 GROUP BY 1, 2)"""


def _asof(s, d, **how):
    w = v.wx(s, d)
    known = w.where("event_id % 2 = 0").withColumn("found", F.col("event_id"))
    return asof.asof(w.where("event_id % 2 = 1").select("event_id", "weatherStation", "time"), known, ["found", "airTemperature"], tie=["event_id"], **how)


@query("j9_asof_nearest", f"""WITH {v.WX}, {ASKED},
b AS (SELECT a.*, k.time AS bt, k.found AS bf, k.t AS ba FROM asked a ASOF LEFT JOIN known k ON a.weatherStation = k.weatherStation AND a.time >= k.time),
f AS (SELECT a.event_id, k.time AS ft, k.found AS ff, k.t AS fa FROM asked a ASOF LEFT JOIN known k ON a.weatherStation = k.weatherStation AND a.time <= k.time),
n AS (SELECT *, bt IS NOT NULL AND (ft IS NULL OR epoch_us(time) - epoch_us(bt) <= epoch_us(ft) - epoch_us(time)) AS back FROM b JOIN f USING (event_id))
SELECT event_id, weatherStation, time, CASE WHEN back THEN bt ELSE ft END AS near_time, CASE WHEN back THEN bf ELSE ff END AS near_found, round(CASE WHEN back THEN ba ELSE fa END, 6) AS near_airTemperature FROM n""")
def _(s, d):
    return rounded(_asof(s, d, bucket_seconds=86400), "near_airTemperature")


@query("j9_asof_backward", f"""WITH {v.WX}, {ASKED}
SELECT event_id, a.weatherStation, a.time, CASE WHEN near THEN k.time END AS near_time, CASE WHEN near THEN k.found END AS near_found, CASE WHEN near THEN round(k.t, 6) END AS near_airTemperature
FROM (SELECT *, epoch_us(time) AS u FROM asked) a ASOF LEFT JOIN known k ON a.weatherStation = k.weatherStation AND a.time >= k.time, LATERAL (SELECT u - epoch_us(k.time) <= 1200000000 AS near)""")
def _(s, d):
    return rounded(_asof(s, d, direction="backward", within="20 minutes"), "near_airTemperature")


@query("j17_densify", """WITH h AS (SELECT DISTINCT date_trunc('hour', ts) AS time, concat('u', user_id % 20) AS weatherStation FROM events), f AS (
  SELECT t.time, s.weatherStation FROM (SELECT DISTINCT time FROM h) t, (SELECT DISTINCT weatherStation FROM h) s)
SELECT f.time, f.weatherStation, h.time IS NOT NULL AS seen FROM f LEFT JOIN h USING (time, weatherStation)""")
def _(s, d):
    hours = v.table(s, d, "events").select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"),
        F.expr("concat('u', user_id % 20)").alias("weatherStation"),
    ).distinct().withColumn("seen", F.lit(True))
    return series.densify(hours).withColumn("seen", F.coalesce("seen", F.lit(False)))
