"""Flows over months and runs, merged statistics, several nearest stations, ranks with common values, first rounds."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from heatloom.functions import geo
from heatloom.operators import model, order, quantile_state, spatial
from heatloom.plans import downscale, harmonise, months
from heatloom.sources import store

T0 = dt.datetime(2023, 12, 20)


def raw_history(spark, days=75, step=6):
    data = [
        (41.2 + 0.1 * k, 2.1, T0 + dt.timedelta(hours=step * h), float(h % 5), -1.0, 290.0 + h * 7 % 24, 285.0, 1.0, 2.0,
         0.0001 * (h * 5 % 23), 3600.0 * 100 * (h * 3 % 24), 0.2, 288.0, 0.3)
        for k in range(2) for h in range(days * 24 // step)
    ]
    names = ["latitude", "longitude", "valid_time", *["u10", "v10", "t2m", "d2m", "lai_lv", "lai_hv", "tp", "ssrd", "fal", "stl4", "swvl4"]]
    return spark.createDataFrame(data, names).withColumn("valid_time", F.col("valid_time").cast("timestamp_ntz"))


COLS = ["weatherStation", "time", "airTemperature", "GHI", "totalPrecipitation", "windDirection"]


def test_months_in_any_order_give_one_pass(spark, tmp_path):
    root, raw = str(tmp_path / "weather"), raw_history(spark).cache()
    only = {m: raw.where(f"year(valid_time) * 100 + month(valid_time) = {m}") for m in (202312, 202401, 202402, 202403)}
    early = only[202312].unionByName(only[202402])
    assert months.fill_months(early, root, 202312, 202403) == [202312, 202402]
    assert months.fill_months(early, root, 202312, 202403) == []
    untouched = {r[0]: r[1] for r in store.current_parts(spark, root).collect()}
    assert months.fill_months(raw, root, 202312, 202402) == [202401]
    versions = {r[0]: r[1] for r in store.current_parts(spark, root).collect()}
    assert set(versions) == {"202312", "202401", "202402"}
    assert all(versions[m] != untouched[m] for m in untouched)  # both had an edge next to the hole
    assert months.fill_months(raw, root, 202312, 202403, months_per_commit=1) == [202403]
    after = {r[0]: r[1] for r in store.current_parts(spark, root).collect()}
    assert after["202312"] == versions["202312"] and after["202401"] == versions["202401"]
    assert rows(months.read_filled(spark, root, 202312, 202403), *COLS) == rows(harmonise.history_weather(raw), *COLS)


def test_a_rerun_after_a_failure_adds_what_is_missing(spark, tmp_path):
    root, raw, calls = str(tmp_path / "weather"), raw_history(spark), []

    def fails(df):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("lost")
        return harmonise.history_weather(df)

    with pytest.raises(OSError):
        months.fill_months(raw, root, 202312, 202403, months_per_commit=1, harmonise=fails)
    assert {r[0] for r in store.current_parts(spark, root).collect()} == {"202312", "202401"}
    assert months.fill_months(raw, root, 202312, 202403) == [202402, 202403]
    assert rows(months.read_filled(spark, root, 202312, 202403), *COLS) == rows(harmonise.history_weather(raw), *COLS)


def test_only_new_and_changed_months_are_predicted(spark, tmp_path):
    weather, out = str(tmp_path / "weather"), str(tmp_path / "out")
    raw = raw_history(spark)
    cells = spark.createDataFrame([("a", "41.2_2.1", 100.0), ("b", "41.3_2.1", 0.0)], "weatherStation string, near string, elevation double")

    def score(df):
        return downscale.station_baseline(df, cells)

    months.fill_months(raw.where("valid_time < '2024-02-01'"), weather, 202312, 202401)
    assert months.predict_months(spark, weather, out, 202312, 202403, score) == [202312, 202401]
    assert months.predict_months(spark, weather, out, 202312, 202403, score) == []
    months.fill_months(raw, weather, 202312, 202403, box=(41.15, 41.35, 2.0, 2.2))
    assert months.predict_months(spark, weather, out, 202312, 202403, score, 1) == [202401, 202402, 202403]
    want = score(harmonise.history_weather(raw))
    assert rows(spark.read.parquet(out), "time", "weatherStation", "airTemperature") == rows(want, "time", "weatherStation", "airTemperature")


def test_a_trained_model_predicts_runs(spark, tmp_path):
    hours = [T0 + dt.timedelta(hours=h) for h in range(24 * 8)]
    raw = spark.createDataFrame(
        [(run, T0 + dt.timedelta(days=run), h, 41.2, 2.1, 1.0, 1.0, 280.0 + h.hour + run, 0.5, 0.0, 10.0 * h.hour)
         for run in range(5) for h in hours if h >= T0 + dt.timedelta(days=run)],
        "run int, issued timestamp_ntz, time timestamp_ntz, lat double, lon double, u double, v double, temp double, rh double, prec double, swflx double",
    ).drop("run")
    got = months.forecast_rows(raw, "2023-12-23", 2)
    assert got.count() == 3 * 96
    first = got.where("forecastingTime = '2023-12-21 01:00:00'").orderBy("time").collect()
    assert first[0]["time"] == dt.datetime(2023, 12, 21, 1) and first[-1]["time"] == dt.datetime(2023, 12, 25)
    assert first[0]["airTemperature"] == pytest.approx(281.0 + 1.5 - 273.15 + 0.0)
    cells = spark.createDataFrame([(f"41.{20 + i}_2.1", i / 10) for i in range(4)], "weatherStation string, elevation double")
    fine = got.where("forecastingTime = '2023-12-22 01:00:00'").select("time", "airTemperature", "relativeHumidity").join(cells, F.expr("elevation >= 0"))
    fine = fine.withColumn("airTemperature", F.col("airTemperature") - F.col("elevation")).drop("elevation")
    lr = got.where("forecastingTime = '2023-12-22 01:00:00'").drop("forecastingTime")
    lr = lr.withColumn("relativeHumidity", F.hour("time") / 24)
    fine = fine.withColumn("relativeHumidity", F.hour("time") / 24)
    near = ["41.2_2.1"]
    fitted, _, ls, hs = downscale.fit_downscaling(fine, lr, cells, ["airTemperature"], near, {"iterations": 3, "depth": 3}, validation_hours=5, n_harmonics=1)
    out = downscale.predict_grid(fitted, got, cells, ls, hs, ["airTemperature"], near, 1, run=("forecastingTime",))
    months.write_forecast(out, str(tmp_path / "f"), "2023-12-23")
    months.write_forecast(out, str(tmp_path / "f"), "2023-12-23")
    kept = spark.read.parquet(str(tmp_path / "f"))
    assert kept.count() == 3 * 96 * 4 == kept.select("forecastingTime", "time", "weatherStation").distinct().count()


@pytest.mark.parametrize("k", [1, 5])
def test_k_nearest_equals_all_pairs(spark, k):
    st = spark.range(200).selectExpr("concat('s', id) AS weatherStation", "41 + (id * 37 % 101) / 500D AS lat", "2 + (id * 53 % 97) / 300D AS lon")
    crowd = spark.range(30).selectExpr("concat('c', id) AS weatherStation", "41.05D AS lat", "2.05D AS lon")
    st = st.unionByName(crowd).cache()
    loc = spark.range(40).selectExpr("concat('l', id) AS name", "40.5 + (id * 31 % 41) / 40D AS lat", "1.5 + (id * 7 % 43) / 40D AS lon")
    loc = loc.unionByName(spark.createDataFrame([("far", -60.0, 170.0), ("on", 41.05, 2.05), ("none", None, 1.0)], "name string, lat double, lon double"))
    places, known = [tuple(r) for r in loc.collect()], [tuple(r) for r in st.collect()]
    want = []
    for name, lat, lon in places:
        if lat is not None:
            best = sorted((((lat - a) ** 2 + (lon - b) ** 2) ** 0.5, s) for s, a, b in known)[:k]
            want += [(name, i + 1, s) for i, (_, s) in enumerate(best)]
    assert rows(spatial.k_nearest(loc, st, k), "name", "rank", "weatherStation") == sorted(want, key=repr)


def test_fewer_stations_than_asked_for(spark):
    st = spark.createDataFrame([("a", 41.0, 2.0), ("b", -41.0, 120.0), ("b", -41.0, 120.0), (None, 1.0, 1.0), ("c", float("nan"), 1.0)], "weatherStation string, lat double, lon double")
    loc = spark.createDataFrame([("x", 10.0, 10.0)], "name string, lat double, lon double")
    assert rows(spatial.k_nearest(loc, st, 5), "name", "rank", "weatherStation") == [("x", 1, "a"), ("x", 2, "b")]
    assert spatial.k_nearest(loc, st.where("false"), 2).count() == 0


@pytest.mark.parametrize("per_doubling", [512, 16])
def test_merged_quantiles_are_within_their_bound(spark, tmp_path, per_doubling):
    random.seed(3)
    data = [(f"s{i % 3}", i % 4, random.gauss(0, 20) if i % 9 else 0.0, float(i % 3 * 8)) for i in range(3000)] + [("s0", 0, None, float("nan"))]
    df = spark.createDataFrame(data, "weatherStation string, month int, a double, b double").cache()
    root = str(tmp_path / "state")
    for m in (2, 0, 3, 1, 0):
        new = quantile_state.add_to_stored_state(df.where(f"month = {m}"), root, str(m), ["a", "b"], per_doubling=per_doubling)
        assert new or m == 0
    exact = {(r["weatherStation"], r["variable"]): r for r in order.quantile_stats(df, ["a", "b"]).collect()}
    merged = quantile_state.stored_stats(spark, root).collect()
    assert len(merged) == len(exact) == 6
    bound = 2 ** (1 / per_doubling) - 1
    for r in merged:
        e = exact[r["weatherStation"], r["variable"]]
        for q in ("q05", "q95"):
            assert abs(r[q] - e[q]) <= bound * abs(e[q]) + 1e-12
    once = quantile_state.quantile_state(df, ["a", "b"], per_doubling=per_doubling)
    assert rows(store.read_store(spark, root).select(once.columns)) == rows(once)


def test_ranks_with_common_values_and_nulls(spark):
    random.seed(4)
    data = [(i, 0.0 if i % 10 else random.random(), None if i % 3 else float(i % 7), random.choice([-1.5, float(i)])) for i in range(5000)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double")
    got = {r["id"]: r for r in order.ecdf_rank(df, ["a", "b", "c"], ["id"]).collect()}
    assert len(got) == 5000
    import bisect

    for k, c in enumerate("abc"):
        values = sorted(r[k + 1] for r in data if r[k + 1] is not None)
        for r in data[:700]:
            want = bisect.bisect_right(values, r[k + 1]) / 4999 if r[k + 1] is not None else 0.0
            assert got[r[0]][f"{c}_percentile"] == pytest.approx(want, abs=1e-12)


def test_first_rounds_are_a_shorter_fit(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    df = spark.range(300).selectExpr("id * 7 % 31 * 1D AS a", "id % 13 * 1D AS b", "sin(id) + id % 13 AS y")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    gbt = GBTRegressor(labelCol="y", predictionCol="p", maxIter=8, maxDepth=3, stepSize=0.3, seed=1)
    whole = gbt.fit(df)
    short, again = model.first_rounds(whole, 3), gbt.setMaxIter(3).fit(df)
    assert short.getNumTrees == 3 and model.first_rounds(whole, 8) is whole
    assert rows(short.transform(df), "a", "b", "p") == rows(again.transform(df), "a", "b", "p")
