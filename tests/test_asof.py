"""As-of lookups against brute force, with a heavy series and awkward rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from heatloom.operators import asof

T0 = dt.datetime(2024, 1, 1)


def brute(asked, known, direction, limit=None):
    out = {}
    for i, k, t in asked:
        own = {}
        for kk, tt, seq, v in known:
            if kk == k and None not in (k, t, tt) and seq >= own.get(tt, (-1, None))[0]:
                own[tt] = (seq, v)
        back = max((x for x in own if x <= t), default=None)
        ahead = min((x for x in own if x >= t), default=None)
        best = {"backward": back, "forward": ahead}.get(direction)
        if direction == "nearest":
            best = back if ahead is None or (back is not None and t - back <= ahead - t) else ahead
        if best is None or (limit is not None and abs(best - t) > limit):
            out[i] = (None, None)
        else:
            out[i] = (best, own[best][1])
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    heavy = lambda: T0 + dt.timedelta(seconds=rng.randint(0, 86400 * 400) // 3600 * 1800)
    known = [("hot", heavy(), k, float(k)) for k in range(3000)]
    known += [("thin", T0 + dt.timedelta(days=900 * k), k, -1.0 * k) for k in range(4)]
    known += [(None, T0, 0, 5.0), ("hot", None, 0, 6.0), ("only known", T0, 0, 7.0), ("null value", T0, 1, None)]
    asked = [(k, rng.choice(["hot"] * 9 + ["thin", "nowhere", "null value"]), heavy()) for k in range(2000)]
    asked += [(5000, None, T0), (5001, "hot", None), (5002, "thin", T0 - dt.timedelta(days=4000)), (5003, "thin", T0 + dt.timedelta(days=9000))]
    left = spark.createDataFrame([(*r, "x") for r in asked], "i int, s string, t timestamp_ntz, v string").repartition(5)
    right = spark.createDataFrame(known, "s string, t timestamp_ntz, seq int, v double").repartition(3)
    return asked, known, left, right


@pytest.mark.parametrize(("direction", "width"), [("nearest", 3600), ("nearest", 10**9), ("backward", 86400 * 30), ("forward", 3600)])
def test_asof_equals_brute_force(tables, direction, width):
    asked, known, left, right = tables
    got = asof.asof(left, right, ["v"], ["s"], "t", ["seq"], direction, bucket_seconds=width)
    assert got.columns == ["i", "s", "t", "v", "near_t", "near_v"]
    rows = got.collect()
    assert len(rows) == len(asked)
    assert {r["i"]: (r["near_t"], r["near_v"]) for r in rows} == brute(asked, known, direction)


def test_asof_within(tables):
    asked, known, left, right = tables
    got = asof.asof(left, right, ["v"], ["s"], "t", ["seq"], within="2 hours").collect()
    assert {r["i"]: (r["near_t"], r["near_v"]) for r in got} == brute(asked, known, "nearest", dt.timedelta(hours=2))


def test_asof_of_empty_tables_and_repeated_rows(tables):
    _, _, left, right = tables
    assert asof.asof(left.where("false"), right, ["v"], ["s"], "t").count() == 0
    none = asof.asof(left, right.where("false"), ["v"], ["s"], "t")
    assert none.count() == left.count() and none.where("near_t IS NOT NULL").count() == 0
    assert asof.asof(left.unionByName(left), right, ["v"], ["s"], "t").count() == 2 * left.count()
    with pytest.raises(ValueError):
        asof.asof(left, right, ["v"], ["s"], "t", direction="sideways")


def test_a_series_is_no_single_task(tables):
    """The rows are shuffled by series and bucket; only bucket ends are by series alone."""
    _, _, left, right = tables
    plan = asof.asof(left, right, ["v"], ["s"], "t", bucket_seconds=86400)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
    parts = asof.asof(left.where("s = 'hot'"), right, ["v"], ["s"], "t", bucket_seconds=86400)
    assert parts.select(F.count("*")).first()[0] == left.where("s = 'hot'").count()
