"""Rings of many corners, holes and crossings against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from heatloom.operators import spatial

SCHEMA = "poly_id int, part_id int, xs array<double>, ys array<double>"


def wavy(n, radius, cx=0.0, cy=0.0, depth=0.2):
    rng = random.Random(n)
    spots = [(radius * (1 - depth * rng.random()), 2 * math.pi * k / n) for k in range(n)]
    return [cx + r * math.cos(t) for r, t in spots], [cy + r * math.sin(t) for r, t in spots]


def odd(x, y, xs, ys):
    inside = False
    for i in range(len(xs)):
        x1, y1, x2, y2 = xs[i - 1], ys[i - 1], xs[i], ys[i]
        if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            inside = not inside
    return inside


def distance(x, y, xs, ys):
    best = math.inf
    for i in range(len(xs)):
        x1, y1, dx, dy = xs[i - 1], ys[i - 1], xs[i] - xs[i - 1], ys[i] - ys[i - 1]
        t = min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return best


@pytest.fixture(scope="module")
def scene(spark):
    rings = [(0, 0, *wavy(50_000, 10.0, depth=0.01)), (0, 1, *wavy(300, 4.0)), (1, 0, *wavy(2000, 3.0, 12.0, 1.0)), (2, 0, [-30.0, -20.0, -20.0], [0.0, 0.0, 40.0])]
    rng = random.Random(7)
    points = [(k, rng.uniform(-32, 17), rng.uniform(-12, 42) if k % 3 else rng.uniform(-11, 11)) for k in range(150)]
    return rings, points, spark.createDataFrame(rings, SCHEMA).cache(), spark.createDataFrame([*points, *points[:9]], "k int, x double, y double")


@pytest.mark.parametrize("bucket", [0.7, 50.0])
def test_within_rings_of_many_corners(scene, bucket):
    rings, points, polys, pts = scene
    inside = {0: lambda x, y: odd(x, y, *rings[0][2:]) != odd(x, y, *rings[1][2:]), 1: lambda x, y: odd(x, y, *rings[2][2:]), 2: lambda x, y: odd(x, y, *rings[3][2:])}
    wanted = {k for k, x, y in points if any(f(x, y) for f in inside.values())}
    got = spatial.within_polygon(pts, "x", "y", polys, bucket)
    assert {r["k"] for r in got.collect()} == wanted and got.columns == ["k", "x", "y"]
    assert 20 < len(wanted) < 140


def test_within_distance_of_many_corners(scene):
    rings, points, polys, pts = scene
    few = [r for r in rings if r[0] == 1]
    wanted = {k for k, x, y in points if odd(x, y, *few[0][2:]) or distance(x, y, *few[0][2:]) <= 4.0}
    got = {r["k"] for r in spatial.within_distance_of_polygon(pts, "x", "y", polys.where("poly_id = 1"), 4.0, bucket=5.0).collect()}
    assert got == wanted and wanted


def test_no_row_holds_a_ring(scene, spark):
    """An edge is listed a few times, and a point meets few edges of a ring of 50,000."""
    _, points, polys, pts = scene
    met = spatial._meet_edges(pts, "x", "y", polys.where("poly_id = 0 AND part_id = 0"), 0.0, 5.0)
    assert not [f for f in met.schema if f.dataType.typeName() == "array"]
    per = met.groupBy("x", "y").count().agg(F.max("count")).first()[0]
    assert per < 2500
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


CASES = [
    ("square", [0, 4, 4, 0], [0, 0, 4, 4], True),
    ("closed square", [0, 4, 4, 0, 0], [0, 0, 4, 4, 0], True),
    ("repeated corner", [0, 4, 4, 4, 0], [0, 0, 0, 4, 4], True),
    ("corner on an edge", [0, 2, 4, 4, 0], [0, 0, 0, 4, 4], True),
    ("clockwise", [0, 0, 4, 4], [0, 4, 4, 0], True),
    ("bow tie", [0, 4, 4, 0], [0, 3, 0, 4], False),
    ("touches a corner", [0, 4, 4, 2, 0], [0, 0, 4, 0, 4], False),
    ("two loops at a corner", [0, 2, 4, 4, 2, 0], [0, 2, 0, 4, 2, 4], False),
    ("runs back", [0, 4, 6, 4, 4, 0], [0, 0, 0, 0, 4, 4], False),
    ("same edge twice", [0, 4, 4, 0, 0, 4, 4, 0], [0, 0, 4, 4, 0, 0, 4, 4], False),
    ("triangle", [0, 1, 0], [0, 0, 1], True),
    ("far crossing", [0, 1000, 1000, 1, 1, 0], [0, 0, 1000, 1000, -1, 1], False),
]


def test_validity(spark):
    rows = [(k, 0, [float(x) for x in xs], [float(y) for y in ys]) for k, (_, xs, ys, _) in enumerate(CASES)]
    n = len(rows)
    rows += [(n, 0, *wavy(20_000, 5.0, depth=0.01)), (n + 1, 0, *wavy(20_000, 5.0, depth=0.01))]
    xs, ys = rows[-1][2], rows[-1][3]
    xs[7], xs[11], ys[7], ys[11] = xs[11], xs[7], ys[11], ys[7]  # one small loop in many corners
    rows += [(n + 2, 0, None, None), (n + 3, 0, [0.0, 1.0], [0.0, 1.0]), (n + 4, 0, [0.0, math.nan, 1.0], [0.0, 1.0, 0.0]), (n + 5, 0, [0.0, 1.0, 2.0], [0.0, 0.0, 0.0])]
    got = {r["poly_id"] for r in spatial.valid_polygons(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k for k, c in enumerate(CASES) if c[3]} | {n}
    assert spatial.valid_polygons(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_long_edge_among_short_ones(spark):
    """A ring's grid lists a long edge cell by cell, not by the cells of its box."""
    xs, ys = wavy(4000, 1.0, depth=0.001)
    rows = [(0, 0, [*xs, 4000.0], [*ys, 3000.0])]
    assert spatial.valid_polygons(spark.createDataFrame(rows, SCHEMA)).count() == 1
