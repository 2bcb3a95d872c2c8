"""Rows that used to be lost or misread."""

import math

import pytest
from pyspark.sql import functions as F

from heatloom.operators import order, spatial
from heatloom.plans.harmonise import history_weather
from heatloom.session import scratch_path, scratch_root
from heatloom.sources import observations, opendata, tables

from conftest import rows


def test_one_ill_typed_field_costs_only_itself(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data":[{"idema":"s1","fint":"2024-01-01T00:00:00","prec":"Ip","ta":3},{"idema":"s2","fint":"2024-01-01T00:00:00","prec":0.5,"ta":{"x":1}}]}')
    (tmp_path / "b.json").write_text('{"data":[{"idema":')
    got = observations.clean_observations(observations.read_observations(spark, str(tmp_path)))
    assert rows(got, "station_id", "precipitation_mm", "air_temp_c") == [("s1", None, 3.0), ("s2", 0.5, None)]


def test_csv_pages(spark, tmp_path):
    (tmp_path / "1.csv").write_text('a,b\n"a ""q"", b","x\ny"\n')
    (tmp_path / "2.csv").write_text("b,a\nwhy,1\n")
    (tmp_path / "3.csv").write_text("a\n2\n")
    expected = [("1", "why"), ("2", None), ('a "q", b', "x\ny")]
    assert rows(opendata.read_csv_strings(spark, str(tmp_path)), "a", "b") == sorted(expected, key=repr)
    assert rows(opendata.read_pages(spark, [str(tmp_path / f"{k}.csv") for k in (1, 2, 3)]), "a", "b") == sorted(expected, key=repr)


def test_csv_pages_of_folders_and_long_headers(spark, tmp_path):
    import gzip

    long = "\n".join(f'line {k} ""of"" a name' for k in range(40))
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "deep").mkdir()
    (tmp_path / "1.csv").write_text('k,"x\ny"\n1,one\n')
    (tmp_path / "2.csv").write_text('k,"x\nz"\n2,"two\nlines"\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "never.csv").write_text('k,"open\n3,4\n')
    (tmp_path / "a b" / "3.csv").write_text(f'k,"{long}"\n3,three\n')
    with gzip.open(tmp_path / "a b" / "deep" / "4.csv.gz", "wt") as f:
        f.write('"x\ny",k\nfour,4\n')
    got = opendata.read_csv_strings(spark, str(tmp_path))
    name = long.replace('""', '"')
    values = {r["k"]: (r["x\ny"], r["x\nz"], r[name]) for r in got.collect() if r["k"]}
    assert values == {"1": ("one", None, None), "2": (None, "two\nlines", None), "3": (None, None, "three"), "4": ("four", None, None)}
    assert opendata.page_headers(spark, [str(tmp_path)]).count() == 5


def test_nan_is_null_on_read(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 1.5)], "k int, value double").write.parquet(str(tmp_path / "v"))
    assert rows(tables.read_gridded(spark, {"t": str(tmp_path / "v")}, ["k"])) == [(1, None), (2, 1.5)]


def test_sea_points_are_dropped(spark):
    names = ["u10", "v10", "t2m", "d2m", "lai_lv", "lai_hv", "tp", "ssrd", "fal", "stl4", "swvl4"]
    row = [280.0] * len(names)
    data = [(41.3, 2.1, f"2024-01-01 0{h}:00:00", *row) for h in range(3)] + [(41.0, 2.4, f"2024-01-01 0{h}:00:00", *row[:2], math.nan, *row[3:]) for h in range(3)]
    df = spark.createDataFrame(data, ["latitude", "longitude", "valid_time", *names]).withColumn("valid_time", F.col("valid_time").cast("timestamp"))
    assert {r[0] for r in history_weather(df).select("weatherStation").collect()} == {"41.3_2.1"}


def test_ranks_of_repeated_ids(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 2.0)], "id string, v double")
    assert rows(order.ecdf_rank(df, ["v"], ["id"])) == [("a", 1 / 3), ("a", 4 / 3), ("b", 4 / 3), ("b", 4 / 3)]


RINGS = [
    (0, 0, [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0]),
    (0, 1, [1.0, 2.0, 2.0, 1.0], [1.0, 1.0, 2.0, 2.0]),  # a hole
    (1, 0, [4.0, 6.0, 6.0, 4.0], [0.0, 0.0, 2.0, 2.0]),  # three more districts around (4, 2)
    (2, 0, [4.0, 6.0, 6.0, 4.0], [2.0, 2.0, 4.0, 4.0]),
]


def test_polygons_are_dissolved(spark):
    polys = spark.createDataFrame(RINGS, "poly_id int, part_id int, xs array<double>, ys array<double>")
    spots = {
        (0.5, 0.5): True, (1.5, 1.5): False, (1.0, 1.5): False, (4.0, 1.0): True, (4.0, 2.0): True, (4.0, 3.0): True, (5.0, 2.0): True,
        (4.0, 4.0): False, (4.0, 0.0): False, (6.0, 2.0): False, (0.0, 0.0): False, (7.0, 1.0): False,
    }
    pts = spark.createDataFrame(list(spots), "x double, y double")
    got = {(r["x"], r["y"]) for r in spatial.within_polygon(pts, "x", "y", polys, bucket=1.5).collect()}
    assert got == {p for p, inside in spots.items() if inside}
    near = {(r["x"], r["y"]) for r in spatial.within_distance_of_polygon(pts, "x", "y", polys, 0.4, bucket=1.5).collect()}
    assert near == set(spots) - {(1.5, 1.5), (7.0, 1.0)}


def test_unfinished_table_is_not_absent(spark, tmp_path):
    (tmp_path / "t" / "_temporary").mkdir(parents=True)
    assert tables.exists(spark, str(tmp_path / "t")) and not tables.exists(spark, str(tmp_path / "u"))
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        tables.get_or_build(spark, str(tmp_path / "t"), lambda: spark.range(1).toDF("x"))


def test_scratch_folder(spark):
    assert scratch_path(spark, "x").startswith(f"{scratch_root(spark)}/heatloom-")
