"""Sources, streams and whole flows on small hand-made files."""

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from heatloom.operators import heat, model, series
from heatloom.plans import downscale, harmonise
from heatloom.sources import observations, opendata, tables
from heatloom.streaming import ingest, intervals

T0 = dt.datetime(2024, 7, 1)


def landed(tmp_path):
    files = {
        "a.json": {"data": [{"idema": "X1", "fint": "2024-07-01T10:00:00", "ta": 20.0}, {"idema": "X1", "fint": "bad", "ta": 1.0}]},
        "b.json": {"data": [{"idema": "X1", "fint": "2024-07-01T10:00:00", "ta": 21.5}, {"idema": None, "fint": "2024-07-01T10:00:00"}]},
        "empty.json": {"data": []},
        "none.json": {"state": 404},
    }
    for i, (name, doc) in enumerate(sorted(files.items())):
        path = tmp_path / name
        path.write_text(json.dumps(doc, indent=1))
        import os

        os.utime(path, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    (tmp_path / "broken.json").write_text('{"data": [ {"idema": ')
    return str(tmp_path)


def test_bad_files_give_no_rows_and_later_file_wins(spark, tmp_path):
    clean = observations.clean_observations(observations.read_observations(spark, landed(tmp_path)))
    assert clean.count() == 2
    merged = observations.merge_observations(clean)
    assert rows(merged, "station_id", "air_temp_c") == [("X1", 21.5)]
    assert set(observations.OBSERVATION_COLUMNS.values()) <= set(merged.columns)


def test_stream_of_files_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    landed(src)
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    ingest.stream_observations(spark, str(src), table, state, max_files=1).awaitTermination()
    assert rows(ingest.current_observations(spark, table), "station_id", "air_temp_c") == [("X1", 21.5)]
    (src / "late.json").write_text(json.dumps({"data": [{"idema": "X1", "fint": "2024-07-01T10:00:00", "ta": 30.0}]}))
    ingest.stream_observations(spark, str(src), table, state).awaitTermination()
    assert rows(ingest.current_observations(spark, table), "station_id", "air_temp_c") == [("X1", 30.0)]


def hourly(spark, n=72, stations=("A", "B")):
    data = [(s, T0 + dt.timedelta(hours=h), float((h * 7 + k) % 31)) for k, s in enumerate(stations) for h in range(n)]
    return spark.createDataFrame(data, "weatherStation string, time timestamp_ntz, heatIndex double")


def streamed(spark, df, folder, parts=6):
    path = str(folder / "source")
    n = df.count() // parts
    for i in range(parts + 1):
        part = df.orderBy("time", "weatherStation").offset(i * n).limit(n)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(df, folder, name):
    out = str(folder / name)
    q = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(folder / f"{name}-state"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.read.parquet(out)


def test_streamed_daily_stats_equal_batch(spark, tmp_path):
    df = hourly(spark)
    got = finish(ingest.stream_daily_stats(streamed(spark, df, tmp_path), "3 hours"), tmp_path, "daily")
    want = heat.daily_stats(df).where("date < '2024-07-03'")
    cols = ["date", "weatherStation", "night_temp_mean", "day_temp_max"]
    assert rows(got, *cols) == rows(want, *cols)


def test_streamed_interval_mean_equals_batch(spark, tmp_path):
    df = hourly(spark, 48)
    got = finish(intervals.stream_interval_mean(streamed(spark, df, tmp_path), ["heatIndex"], "2 hours"), tmp_path, "mean")
    want = series.interval_mean(df, ["heatIndex"]).where(F.col("time") < F.lit(T0 + dt.timedelta(hours=44)))
    got = got.withColumn("time", F.col("time").cast("timestamp_ntz"))
    assert rows(got.where(F.col("time") < F.lit(T0 + dt.timedelta(hours=44))), "weatherStation", "time", "heatIndex") == rows(
        want, "weatherStation", "time", "heatIndex"
    )
    assert got.count() == got.select("weatherStation", "time").distinct().count()


def test_streamed_dedup(spark, tmp_path):
    df = hourly(spark, 10).unionByName(hourly(spark, 10))
    got = finish(ingest.stream_dedup(streamed(spark, df, tmp_path), ["weatherStation", "time"], "4 hours"), tmp_path, "once")
    assert got.count() == 20


def test_month_is_replaced_alone(spark, tmp_path):
    root = str(tmp_path / "months")
    df = hourly(spark, 24 * 62, ("A",)).withColumnRenamed("heatIndex", "airTemperature")
    tables.write_predictions(df, root)
    tables.write_predictions(df.where("month(time) = 8").withColumn("airTemperature", F.lit(-1.0)), root)
    per = tables.read_months(spark, root).groupBy("ym").agg(F.count("*").alias("n"), F.max("airTemperature").alias("m"))
    assert rows(per, "ym", "n", "m") == [(202407, 744, 30.0), (202408, 744, -1.0)]


def test_parts_continue_and_updates_win(spark, tmp_path):
    root = str(tmp_path / "parts")
    schema = "`:id` string, `:updated_at` string, v string"
    first = spark.createDataFrame([("1", "2020", "a"), ("2", "2020", "b")], schema)
    second = spark.createDataFrame([("1", "2020", "ignored"), ("2", "2021", "newer")], schema)
    opendata.load_increment(first, root)
    got = opendata.load_increment(second, root)
    assert rows(got, ":id", "v") == [("1", "a"), ("2", "newer")]
    assert opendata.next_part(spark, root) == 2
    assert rows(opendata.load_increment(second.where("false"), root), ":id", "v") == [("1", "a"), ("2", "newer")]


def test_pages_with_extra_column(spark, tmp_path):
    (tmp_path / "p1.csv").write_text(":id,a\n1,x\n")
    (tmp_path / "p2.csv").write_text(":id,a,b\n2,y,007\n")
    got = opendata.read_pages(spark, [str(tmp_path / "p1.csv"), str(tmp_path / "p2.csv")])
    assert rows(got, ":id", "a", "b") == [("1", "x", None), ("2", "y", "007")]


def test_build_once(spark, tmp_path):
    path, calls = str(tmp_path / "static"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert tables.get_or_build(spark, path, build).count() == 3
    assert tables.get_or_build(spark, path, build).count() == 3
    assert calls == [1]


def raw_history(spark, hours=48):
    data = [
        (41.2 + 0.1 * k, 2.1, T0 + dt.timedelta(hours=h), 1.0, -1.0, 290.0 + h % 24, 285.0, 1.0, 2.0,
         0.0001 * (h % 24), 3600.0 * 100 * (h % 24), 0.2, 288.0, 0.3)
        for k in range(2) for h in range(hours)
    ]
    names = ["latitude", "longitude", "valid_time", *["u10", "v10", "t2m", "d2m", "lai_lv", "lai_hv", "tp", "ssrd", "fal", "stl4", "swvl4"]]
    return spark.createDataFrame(data, names).withColumn("valid_time", F.col("valid_time").cast("timestamp_ntz"))


def test_history_columns(spark):
    from heatloom.operators.model import HISTORY_ORDER

    out = harmonise.history_weather(raw_history(spark).withColumns({"step": F.lit(1), "number": F.lit(0)}))
    assert set(out.columns) == set(HISTORY_ORDER) | {"time", "weatherStation", "dewAirTemperature", "windSpeedEast", "windSpeedNorth"}
    assert out.count() == 96
    r = out.where("weatherStation = '41.2_2.1'").orderBy("time").collect()
    assert r[0]["GHI"] == 0 and r[1]["GHI"] == pytest.approx(100) and r[-1]["GHI"] == 0
    assert r[1]["totalPrecipitation"] == pytest.approx(0.1)
    assert 0 < r[5]["relativeHumidity"] <= 1.2


def test_static_features_are_scaled(spark):
    grid = spark.range(25).selectExpr("41.38 + 0.001 * (id % 5) AS lat", "2.15 + 0.001 * (id div 5) AS lon")
    cells = downscale.grid_cells(grid)
    x0, y0 = 428000.0, 4583000.0
    raster = spark.range(300 * 300).selectExpr("CAST(id div 300 AS INT) AS row", "CAST(id % 300 AS INT) AS col", "CAST(id % 200 AS DOUBLE) AS value")
    buildings = cells.selectExpr("x + 10 AS bx", "y - 10 AS by", "CAST(hash(weatherStation) % 100 AS DOUBLE) AS area", "3.0D AS floors").unionByName(
        cells.selectExpr("x + 49 AS bx", "y AS by", "5.0D AS area", "7.0D AS floors")
    )
    affine = (x0, 20.0, y0, 20.0)
    got = downscale.static_features(
        cells, raster, affine, buildings, raster, affine, (x0, y0 - 6000, x0 + 6000, y0), ["area"], ["floors"]
    )
    assert got.count() == 25
    for c in got.columns[1:]:
        lo, hi = got.agg(F.min(c), F.max(c)).first()
        assert lo is not None and lo >= 0 and hi <= 1, c
    assert set(got.columns) == {"weatherStation", "elevation", "area_percentile", "floors_percentile", "ndvi_min", "ndvi_max", "ndvi_mean"}


def test_eighteen_static_features_are_stored(spark):
    cells = spark.range(9).selectExpr("concat('c', id) AS weatherStation", "50D + 100 * (id % 3) AS x", "50D + 100 * (id div 3) AS y")
    raster = spark.range(900).selectExpr("CAST(id div 30 AS INT) AS row", "CAST(id % 30 AS INT) AS col", "CAST(id % 200 + 1 AS DOUBLE) AS value")
    each = [F.expr(f"hash(weatherStation, {i}) % 50 * 1D").alias(c) for i, c in enumerate(downscale.BUILDING_SUMS + downscale.BUILDING_MEANS)]
    buildings = cells.select(F.col("x").alias("bx"), F.col("y").alias("by"), *each)
    affine = (0.0, 10.0, 300.0, 10.0)
    got = downscale.static_features(cells, raster, affine, buildings, raster, affine, (0.0, 0.0, 300.0, 300.0))
    features = [c for c in got.columns if c != "weatherStation"]
    assert len(features) == 18 and got.count() == 9
    assert not [c for c in features if "undeveloped" in c or c == "geometry"]


def test_training_beats_the_mean_and_predicts_every_row(spark):
    data = [
        (h, T0 + dt.timedelta(hours=h), "41.3_2.1", float(h % 24) / 24, None if h % 7 == 0 else h % 5 / 5.0, (h % 24) / 24 * 0.8 + 0.1)
        for h in range(400)
    ]
    df = spark.createDataFrame(data, "id int, time timestamp_ntz, weatherStation string, a double, b double, y_airTemperature double")
    df = df.withColumn("held", F.col("id") % 5 == 0)
    fitted = model.train(df, ["a", "b"], ["airTemperature"], {"iterations": 10, "depth": 3, "learn_rate": 0.5}, "held")
    out = model.predict(fitted, df)
    assert out.count() == 400
    error = model.rmse(out.where("held"), {"y_airTemperature": "pred_airTemperature"}).first()["rmse"]
    assert error < 0.1


def test_rounds_look_on_for_their_patience():
    errors = [5.0, 4.0, 4.5, 4.4, 3.0, 3.5, 3.6, 3.7, 1.0]
    assert model.best_rounds(errors, 2) == 2
    assert model.best_rounds(errors, 3) == 5
    assert model.best_rounds(errors, 30) == 9
    assert model.best_rounds([1.0], 30) == 1
