"""Streams over the given tables, run to the end and read back.

Results land in Parquet in the scratch folder; nothing passes the driver.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import endings, ingest, intervals
from . import views as v
from .registry import query, r6, rounded, sql_r6
from .storage import observation_lines


def _events(s, d):
    """The events table as a file stream. A glob also accepts a table that is
    a single file."""
    schema = v.table(s, d, "events").schema
    return s.readStream.schema(schema).parquet(f"{d}/events.parque[t]")


def _run(s, df, name, markers=None):
    """Runs to the end of the input; with a folder of markers closes the stream and goes on from the checkpoint."""
    out, state = scratch_path(s, name), scratch_path(s, f"{name}-state")

    def go():
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    go()
    if markers:
        endings.close(s, markers)
        go()
    return s.read.parquet(out)


@query("t1_stream_observations", """WITH o AS (SELECT event_id, concat('st', user_id % 40) AS station_id, date_trunc('second', ts) AS datetime, value AS air_temp_c FROM events WHERE event_id % 10 NOT IN (3, 4, 5))
SELECT station_id, datetime, air_temp_c FROM o QUALIFY row_number() OVER (PARTITION BY station_id, datetime ORDER BY event_id DESC) = 1""")
def _(s, d):
    landed, stored, state = (scratch_path(s, n) for n in ("landed", "stored", "stored-state"))
    observation_lines(s, d).write.text(landed)
    ingest.stream_observations(s, landed, stored, state, whole_files=False).awaitTermination()
    return ingest.current_observations(s, stored).select("station_id", "datetime", "air_temp_c")


STATS = [f"{a}_temp_{b}" for a in ("night", "day") for b in ("min", "mean", "max")]


@query("t2_stream_daily_stats", f"""WITH {v.WX}, g AS (SELECT CAST(time AS DATE) AS date, weatherStation,
 {', '.join(f"{fn}(CASE WHEN {c} THEN airTemperature END) AS {side}_temp_{n}" for side, c in (('night', 'NOT hour(time) BETWEEN 9 AND 20'), ('day', 'hour(time) BETWEEN 9 AND 20')) for n, fn in (('min', 'min'), ('mean', 'avg'), ('max', 'max')))}
 FROM wx GROUP BY 1, 2) SELECT CAST(date AS VARCHAR) AS date, weatherStation, {sql_r6(*STATS)} FROM g""")
def _(s, d):
    markers = scratch_path(s, "daily-markers")
    daily = ingest.stream_daily_stats(endings.closable(v.wx_of(_events(s, d)), markers), "6 hours", "airTemperature")
    out = _run(s, daily, "daily", markers)
    return rounded(out.withColumn("date", F.col("date").cast("string")).select("date", "weatherStation", *STATS), *STATS)


# Humidity counts as an angle here; batches are weeks, and rows of one time are ordered by event.
WEEK = "(dayofyear(time) - 1) // 7"


@query("t3_stream_interval_mean", f"""WITH {v.WX}, n AS (SELECT event_id, weatherStation, {WEEK} AS week, time, airTemperature AS a, relativeHumidity * 360 AS h, lead(airTemperature) OVER w AS na, lead(relativeHumidity * 360) OVER w AS nh
 FROM wx WINDOW w AS (PARTITION BY weatherStation, {WEEK} ORDER BY time, event_id)),
m AS (SELECT *, degrees(atan2(sin(radians(h)) + sin(radians(nh)), cos(radians(h)) + cos(radians(nh)))) AS turn FROM n)
SELECT event_id, weatherStation, week::INTEGER AS week, time, round(coalesce((a + na) / 2, a), 6) + 0.0::double AS airTemperature,
 round(CASE WHEN na IS NULL THEN sin(radians(h)) WHEN abs(sin(radians((h - nh) / 2))) > 0.999 THEN 9 ELSE sin(radians(turn)) END, 6) + 0.0::double AS sine FROM m""")
def _(s, d):
    markers = scratch_path(s, "mean-markers")
    rows = v.wx_of(_events(s, d)).withColumns({"week": F.expr("CAST((dayofyear(time) - 1) div 7 AS INT)"), "turn": F.col("relativeHumidity") * 360})
    means = intervals.stream_interval_mean(
        endings.closable(rows, markers), ["airTemperature", "turn"], "2 hours", tie=["event_id"], batch_col="week", circular=["turn"]
    )
    out = _run(s, means, "interval-mean", markers)
    # Opposite directions have no mean; their sine is left out of the comparison, as in the SQL.
    raw = v.wx(s, d).select("event_id", (F.col("relativeHumidity") * 360).alias("h")).withColumnRenamed("event_id", "_e")
    after = F.lead("h").over(Window.partitionBy("weatherStation", "week").orderBy("time", "event_id"))
    both = out.join(raw, F.col("event_id") == F.col("_e")).withColumn("nh", after)
    opposite = F.coalesce(F.abs(F.sin(F.radians((F.col("h") - F.col("nh")) / 2))) > 0.999, F.lit(False))
    return both.select("event_id", "weatherStation", "week", F.col("time").cast("timestamp_ntz").alias("time"), r6("airTemperature").alias("airTemperature"),
                       r6(F.when(opposite, F.lit(9.0)).otherwise(F.sin(F.radians("turn")))).alias("sine"))


@query("t4_stream_dedup", f"WITH {v.OBS} SELECT DISTINCT obs_key FROM obs")
def _(s, d):
    first = ingest.stream_dedup(v.obs_of(_events(s, d)), ["obs_key"], "1 hour", "datetime")
    return _run(s, first, "dedup").select("obs_key")
