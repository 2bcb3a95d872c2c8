import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from heatloom.functions import clock, geo, keys, solar, weather
from heatloom.operators import dedup, model, order, spatial, tables


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_border_station_is_out(spark):
    df = spark.createDataFrame([("41.2_1.9", 41.2, 1.9), ("41.3_2.0", 41.3, 2.0)], "k string, lat double, lon double")
    assert rows(tables.within_bbox(df, "lat", "lon", (41.2, 41.6, 1.9, 2.4)), "k") == [("41.3_2.0",)]


@pytest.mark.parametrize(("u", "v", "d"), [(0, -1, 0), (-1, 0, 90), (0, 1, 180), (1, 0, 270)])
def test_wind_direction(spark, u, v, d):
    got = one(spark, d=weather.wind_direction(F.lit(float(u)), F.lit(float(v))))["d"]
    assert got % 360 == pytest.approx(d)


@pytest.mark.parametrize(
    ("lat", "lon", "key"),
    [(41.2, 2.0, "41.2_2.0"), (41.1234567, -2.5, "41.123457_-2.5"), (0.0005, 0.0, "0.0005_0.0"), (-0.00012, 100.0, "-0.00012_100.0")],
)
def test_station_key(spark, lat, lon, key):
    assert one(spark, k=keys.station_key(F.lit(lat), F.lit(lon)))["k"] == key


def test_station_key_of_floats_and_round_trip(spark):
    got = one(spark, k=keys.station_key(F.lit(41.2).cast("float"), F.lit(2.1).cast("float")))["k"]
    assert got == "41.2_2.1"
    back = one(spark, a=keys.station_lat(F.lit(got)), b=keys.station_lon(F.lit(got)))
    assert (back["a"], back["b"]) == (41.2, 2.1)


def test_model_name_round_trip(spark):
    name = "cat_0_41.2,41.6_1.9,2.4_26280_200_4_400_0.03_6_4"
    r = keys.parse_model_name(spark.createDataFrame([(name,)], "name string"), "name").first().asDict()
    r.pop("name")
    assert keys.format_model_name("cat", r) == name


@pytest.mark.parametrize(
    ("name", "words"), [("airTemperature", "air temperature"), ("GHI", "ghi"), ("windSpeedEast", "wind speed east"), ("ndvi", "ndvi")]
)
def test_camel_to_words(spark, name, words):
    assert one(spark, w=keys.camel_to_words(F.lit(name)))["w"] == words


def test_forecast_hours(spark):
    hours = one(spark, h=clock.forecast_hours(F.lit("2025-06-26 17:45:00").cast("timestamp")))["h"]
    assert len(hours) == 96 and str(hours[0]) == "2025-06-26 01:00:00" and str(hours[-1]) == "2025-06-30 00:00:00"


def test_drop_nulls_keeps_nan(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3)], "a double, b int")
    assert rows(tables.drop_nulls(df), "b") == [(1,), (2,)]


def test_equal_quantiles_scale_to_null(spark):
    got = one(spark, a=weather.quantile_scale(F.lit(0.0), F.lit(0.0), F.lit(0.0)))["a"]
    assert got is None


def test_scale_round_trip(spark):
    x, lo, hi = F.lit(7.3), F.lit(2.0), F.lit(9.0)
    assert one(spark, a=weather.quantile_unscale(weather.quantile_scale(x, lo, hi), lo, hi))["a"] == pytest.approx(7.3)


def test_humidity_of_dew_point(spark):
    assert one(spark, h=weather.relative_humidity(F.lit(20.0), F.lit(20.0)))["h"] == pytest.approx(1.0)
    assert one(spark, h=weather.relative_humidity(F.lit(None).cast("double"), F.lit(2.0)))["h"] is None


def test_sun_position_published(spark):
    df = spark.createDataFrame([(39.742476, -105.1786, 11.0)], "latitude double, longitude double, airTemperature double")
    df = df.withColumn("time", F.lit("2003-10-17 19:30:30").cast("timestamp_ntz"))
    r = solar.sun_position(df, shift_minutes=0).first()
    assert r["sunElevation"] == pytest.approx(39.872, abs=0.01)
    assert r["sunAzimuth"] == pytest.approx(194.34, abs=0.01)
    assert 90 - r["apparentZenith"] == pytest.approx(39.888, abs=0.01)


def test_disc_behaviour(spark):
    r = one(
        spark,
        low=solar.disc_dni(F.lit(500.0), F.lit(88.0), F.lit(100)), dark=solar.disc_dni(F.lit(0.0), F.lit(40.0), F.lit(100)),
        night=solar.disc_dni(F.lit(10.0), F.lit(150.0), F.lit(100)), clear=solar.disc_dni(F.lit(1038.62), F.lit(10.567), F.lit(175)),
    )
    assert r["low"] == 0 and r["night"] == 0 and r["dark"] == pytest.approx(0, abs=30)
    assert 750 < r["clear"] < 900


def test_utm_published(spark):
    a = one(spark, p=geo.to_utm(F.lit(45.0), F.lit(3.0)))["p"]
    assert (a["x"], a["y"]) == (pytest.approx(500000.0), pytest.approx(4982950.400, abs=0.01))
    b = one(spark, p=geo.to_utm(F.lit(41.38), F.lit(2.17)))["p"]
    assert (b["x"], b["y"]) == (pytest.approx(430597.86, abs=0.01), pytest.approx(4581274.38, abs=0.01))


def test_cell_shape_is_checked():
    with pytest.raises(ValueError):
        geo.cell_bounds(None, None, 100, "hexagon")


def test_keep_last_and_first(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 1, "d")], "k int, s int, v string")
    assert rows(dedup.dedup_keep_last(df, ["k"], ["s"]), "k", "v") == [(1, "b"), (2, "d")]
    assert rows(dedup.dedup_keep_first(df, ["k"], ["s"]), "k", "v") == [(1, "a"), (2, "d")]


def test_upsert_new_wins(spark):
    old = spark.createDataFrame([(1, 9, "old"), (2, 1, "keep")], "k int, s int, v string")
    new = spark.createDataFrame([(1, 1, "new"), (3, 1, "add")], "k int, s int, v string")
    assert rows(dedup.upsert_keep_last(old, new, ["k"], ["s"]), "k", "v") == [(1, "new"), (2, "keep"), (3, "add")]


def test_incremental_takes_all_when_nothing_is_stored(spark):
    new = spark.createDataFrame([("1", "2020"), ("2", "2021")], "`:id` string, `:updated_at` string")
    assert tables.incremental_since(new, new.where("false"), ":updated_at").count() == 2
    assert rows(tables.incremental_since(new, new.where("`:id` = '1'"), ":updated_at")) == [("2", "2021")]


def test_append_aligned(spark):
    a, b = spark.createDataFrame([("x",)], "a string"), spark.createDataFrame([("y", "z")], "a string, b string")
    assert rows(tables.append_aligned(a, b)) == [("x", None), ("y", "z")]


@pytest.mark.parametrize("shards", [1, 7])
def test_paired_product(spark, shards):
    got = tables.paired_product(spark.range(5).toDF("a"), spark.range(11).toDF("b"), shards)
    assert rows(got, "a", "b") == sorted(((a, b) for a in range(5) for b in range(11)), key=repr)


def test_ecdf_rank(spark):
    df = spark.createDataFrame([(i, float(x), 4.0) for i, x in enumerate((1, 2, 2, 5))], "id int, v double, c double")
    got = {r["id"]: (r["v_percentile"], r["c_percentile"]) for r in order.ecdf_rank(df, ["v", "c"], ["id"]).collect()}
    assert [round(got[i][0], 6) for i in range(4)] == [0.333333, 1.0, 1.0, 1.333333]
    assert all(got[i][1] == 0 for i in range(4))
    assert order.ecdf_rank(df.where("id = 0"), ["v"], ["id"]).first()["v_percentile"] == 0


@pytest.mark.parametrize("splits", [2, 64])
def test_ecdf_rank_equals_counting(spark, splits):
    df = spark.range(400).selectExpr("id", "CAST(pmod(hash(id), 83) AS DOUBLE) AS v")
    values = [r["v"] for r in df.collect()]
    for r in order.ecdf_rank(df, ["v"], ["id"], splits).join(df, "id").collect():
        assert r["v_percentile"] == pytest.approx(sum(x <= r["v"] for x in values) / 399)


def test_ecdf_rank_keeps_rows_out_of_aggregates(spark):
    """Rows are only joined with ranks: an aggregate of them would hold a task's whole share in memory."""
    df = spark.range(3000).selectExpr("id div 2 AS id", "CASE WHEN id % 10 = 0 THEN id % 700 / 7D ELSE -0D END AS v", "CASE WHEN id % 3 > 0 THEN id % 11 END AS c")
    got = order.ecdf_rank(df, ["v", "c"], ["id"])
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    held = [tuple(r) for r in df.collect()]
    at_most = lambda k, x: 0.0 if x is None else sum(r[k] is not None and r[k] <= x for r in held) / 2999
    known = {(k, x): at_most(k, x) for k in (1, 2) for x in {r[k] for r in held}}
    assert rows(got) == sorted(((i, known[1, v], known[2, c]) for i, v, c in held), key=repr)


@pytest.mark.parametrize("value", ["abs(hash(id)) % 5000 / 7D", "hash(id) / 1e6D", "1e9D + rand(3)", "CASE WHEN id % 5 = 0 THEN double('-Infinity') ELSE 4.9e-324D * (id % 3) END", "-id % 4 * 1e308D"])
def test_quantiles_equal_percentile(spark, value):
    df = spark.range(30000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 > 0 THEN concat('s', id % 50) END AS weatherStation",
        f"CASE WHEN id % 7 = 0 THEN 0D WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN double('NaN') ELSE {value} END AS v",
    )
    want = df.where("v IS NOT NULL AND NOT isnan(v)").groupBy("weatherStation").agg(F.expr("percentile(v, array(0.05D, 0.95D))").alias("q"))
    want = {r["weatherStation"]: r["q"] for r in want.collect()}
    got = {r["weatherStation"]: [r["q05"], r["q95"]] for r in order.quantile_stats(df, ["v"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_minmax_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, b double")
    assert rows(order.minmax_01(df, ["a", "b"])) == [(0.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("n_hours, n_steps", [(100, 8), (90, 7)])
def test_chunks_cover_the_first_hours(spark, n_hours, n_steps):
    df = spark.range(150).selectExpr("timestamp_micros(id * 3600000000) AS time")
    got = model.chunk_times(df, n_hours, n_steps)
    size = math.ceil(n_hours / n_steps)
    counts = {r["chunk"]: r["count"] for r in got.groupBy("chunk").count().collect()}
    assert sum(counts.values()) == n_hours
    assert all(counts[c] == size for c in range(n_steps - 1))


def test_split_is_by_whole_times(spark):
    df = spark.range(1000).selectExpr("timestamp_micros((id % 100) * 3600000000) AS time", "id")
    per = model.split_by_time(df, 0.1).groupBy("time").agg(F.count_distinct("is_test").alias("n"), F.max("is_test").alias("t"))
    got = per.collect()
    assert all(r["n"] == 1 for r in got) and sum(r["t"] for r in got) == 10


def square(spark, *extra):
    data = [(0, 0, [0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0]), *extra]
    return spark.createDataFrame(data, "poly_id int, part_id int, xs array<double>, ys array<double>")


def test_points_on_the_border_are_out(spark):
    pts = spark.createDataFrame([(0.5, 0.5), (0.0, 0.5), (0.0, 0.0), (1.0, 1.0), (0.5, 1.0), (1.5, 0.5)], "x double, y double")
    assert rows(spatial.within_polygon(pts, "x", "y", square(spark), bucket=0.3)) == [(0.5, 0.5)]


def test_invalid_rings_are_dropped(spark):
    bad = [(1, 0, [0.0, 1.0], [0.0, 1.0]), (2, 0, [0.0, 1.0, 2.0], [0.0, 0.0, 0.0]), (3, 0, None, None),
           (4, 0, [0.0, float("nan"), 1.0], [0.0, 1.0, 1.0])]
    assert rows(spatial.valid_polygons(square(spark, *bad)), "poly_id") == [(0,)]


def test_distance_rounds_corners(spark):
    pts = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (1.36, 1.36), (1.35, 1.35), (1.51, 0.5)], "x double, y double")
    got = spatial.within_distance_of_polygon(pts, "x", "y", square(spark), 0.5, bucket=1.0)
    assert rows(got) == [(0.5, 0.5), (1.35, 1.35), (1.5, 0.5)]


@pytest.mark.parametrize("shape", ["square", "circle"])
def test_points_in_cells_equal_all_pairs(spark, shape):
    pts = spark.range(600).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 12D ELSE (id * 37 % 101) / 2D END AS px", "(id * 53 % 97) / 2D AS py")
    cells = spark.range(60).selectExpr("id AS cell", "(id * 17 % 50) * 1D AS x", "(id * 29 % 47) * 1D AS y")
    got = rows(spatial.points_in_cells(pts, cells, 4.0, shape=shape), "id", "cell")
    test = "abs(px - x) < 4 AND abs(py - y) < 4" if shape == "square" else "pow(px - x, 2) + pow(py - y, 2) < 16"
    assert got == rows(pts.join(cells, F.expr(test)), "id", "cell")


def test_nearest_equals_all_pairs(spark):
    st = spark.range(200).selectExpr("concat('s', id) AS weatherStation", "41 + (id * 37 % 101) / 500D AS lat", "2 + (id * 53 % 97) / 300D AS lon")
    loc = spark.range(40).selectExpr("concat('l', id) AS name", "40.5 + (id * 31 % 41) / 40D AS lat", "1.5 + (id * 7 % 43) / 40D AS lon")
    far = spark.createDataFrame([("far", -60.0, 170.0), ("on", 41.0, 2.0)], "name string, lat double, lon double")
    loc = loc.unionByName(far)
    d = geo.euclid(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    want = loc.alias("a").join(st.alias("b"), F.expr("true")).groupBy("a.name").agg(F.min(F.struct(d.alias("d"), "weatherStation")).alias("m"))
    assert rows(spatial.nearest(loc, st), "name", "weatherStation") == rows(want, "name", "m.weatherStation")


def test_zonal_of_empty_cell_is_null(spark):
    cells = spark.createDataFrame([(1, 50.0, 50.0), (2, 950.0, 950.0)], "cell int, x double, y double")
    px = spark.createDataFrame([(40.0, 40.0, 2.0), (60.0, 60.0, 4.0), (100.0, 50.0, 9.0)], "px double, py double, value double")
    got = rows(spatial.zonal_stats(cells, px, 50.0, "cell"), "cell", "ndvi_min", "ndvi_max", "ndvi_mean")
    assert got == [(1, 2.0, 4.0, 3.0), (2, None, None, None)]
