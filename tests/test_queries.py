"""Every registered query against its SQL on the same tables."""

import math
import statistics

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from heatloom.catalog import modelling, registry
from heatloom.operators import model
from heatloom.plans import downscale

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# Pairs without a key, and rows that leave the JVM.
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"]
QUERIES = registry.QUERIES
SQL = registry.SQL


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    yield con
    con.close()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"m4_predict"}))
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    got = df.collect()
    if name in SQL:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [node for node in UNWANTED if node in plan]
    if name not in SQL:
        assert got, "a query without SQL must at least give rows"
        return
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = table_of(columns, cursor.fetchall())
    actual = table_of(df.columns, [tuple(r) for r in got])
    assert len(actual) == len(expected)
    assert actual == expected


def test_entry_has_rows_and_all_flags(spark):
    df = entry_module.entry(spark)
    assert len(df.columns) == 18
    assert df.count() > 0


def test_predictions_are_near_the_truth_of_hours_not_trained_on(spark, data):
    """Every hour of every cell has one, and those of the test hours miss the truth by far less than its spread."""
    rows = QUERIES["m4_predict"](spark, data).collect()
    truth, lr, static = modelling._training(spark, data)
    keys = {(r["time"], r["weatherStation"]) for r in rows}
    hours = {r["time"] for r in lr.where(F.col("weatherStation").isin(modelling.STATIONS)).select("time").distinct().collect()}
    assert len(rows) == len(keys) and keys == {(t, r["weatherStation"]) for t in hours for r in static.collect()}
    common = downscale.training_hours(truth, lr)
    test = {r["time"] for r in model.split_times(common, 0.1, 42).where("is_test").collect()}
    real = {(r["time"], r["weatherStation"]): r for r in truth.collect() if r["time"] in test}
    # 40 rounds at a rate of 0.03 leave about 0.97 ** 40 = 0.3 of any spread.
    for name, share in (("airTemperature", 0.5), ("relativeHumidity", 0.85)):
        pairs = [(r[name], real[r["time"], r["weatherStation"]][name]) for r in rows if (r["time"], r["weatherStation"]) in real]
        assert len(pairs) > 100 and all(p is not None and math.isfinite(p) for p, _ in pairs)
        error = math.sqrt(sum((p - y) ** 2 for p, y in pairs) / len(pairs))
        assert error < share * statistics.pstdev(y for _, y in pairs), (name, error)


def test_only_training_has_no_sql():
    assert set(QUERIES) - set(SQL) == {"m3_train", "m4_predict"}
