"""Points, cells, polygons and rasters.

Spatial matches are equi-joins on a square bucket followed by an exact test.
Boxes are listed under each bucket they touch, so a point needs one lookup.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import euclid, to_utm
from ..session import materialise


def _span(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / F.lit(size)), F.floor(hi / F.lit(size)))


def _bucket_boxes(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, size: float) -> DataFrame:
    return df.withColumn("_bx", F.explode(_span(x0, x1, size))).withColumn("_by", F.explode(_span(y0, y1, size)))


def _bucket_points(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns(
        {"_bx": F.floor(F.col(x) / F.lit(size)), "_by": F.floor(F.col(y) / F.lit(size))}
    )


def _bucket_join(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points meet boxes of their bucket. Spark broadcasts the boxes or splits a
    crowded bucket's points by the sizes it measures."""
    return points.join(boxes, ["_bx", "_by"]).drop("_bx", "_by")


def points_in_cells(
    points: DataFrame, cells: DataFrame, half: float, px: str = "px", py: str = "py",
    cx: str = "x", cy: str = "y", shape: str = "square",
) -> DataFrame:
    """Points with the cells that strictly contain them (inner pairs).

    ``half`` is half the side of a square or the radius of a circle.
    """
    size = 2.0 * half
    h = F.lit(float(half))
    boxes = _bucket_boxes(cells, F.col(cx) - h, F.col(cx) + h, F.col(cy) - h, F.col(cy) + h, size)
    pairs = _bucket_join(_bucket_points(points, px, py, size), boxes)
    dx, dy = F.col(px) - F.col(cx), F.col(py) - F.col(cy)
    if shape == "circle":
        return pairs.where(dx * dx + dy * dy < h * h)
    return pairs.where((F.abs(dx) < h) & (F.abs(dy) < h))


def left_fill_zero(cells: DataFrame, agg: DataFrame, key: str) -> DataFrame:
    """All cells; missing aggregates become 0."""
    cols = [c for c in agg.columns if c != key]
    return cells.join(agg, key, "left").na.fill(0, cols)


def cell_attributes(
    joined: DataFrame, cell: str, sums: Sequence[str], means: Sequence[str] = ()
) -> DataFrame:
    return joined.groupBy(cell).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means]
    )


def zonal_stats(cells: DataFrame, pixels: DataFrame, half: float, cell: str, value: str = "value",
                prefix: str = "ndvi", px: str = "px", py: str = "py") -> DataFrame:
    """min, max and mean of the pixels whose centre lies in each cell; null
    where a cell has none."""
    inside = points_in_cells(pixels, cells, half, px, py).groupBy(cell).agg(
        F.min(value).alias(f"{prefix}_min"),
        F.max(value).alias(f"{prefix}_max"),
        F.avg(value).alias(f"{prefix}_mean"),
    )
    return cells.join(inside, cell, "left")


def pixel_centres(pixels: DataFrame, affine: Sequence[float]) -> DataFrame:
    """Adds centre coordinates; ``affine`` is (x0, dx, y0, dy) with y falling."""
    x0, dx, y0, dy = affine
    return pixels.withColumns(
        {
            "px": F.lit(float(x0)) + (F.col("col") + F.lit(0.5)) * F.lit(float(dx)),
            "py": F.lit(float(y0)) - (F.col("row") + F.lit(0.5)) * F.lit(float(dy)),
        }
    )


def crop_pixels(pixels: DataFrame, affine: Sequence[float], bbox: Sequence[float]) -> DataFrame:
    """Pixels whose centre lies in ``(xmin, ymin, xmax, ymax)``."""
    c = pixel_centres(pixels, affine)
    return c.where(F.col("px").between(bbox[0], bbox[2]) & F.col("py").between(bbox[1], bbox[3]))


def sample_raster(points: DataFrame, pixels: DataFrame, affine: Sequence[float], x: str = "x",
                  y: str = "y", value: str = "value", alias: str = "elevation") -> DataFrame:
    """Value of the pixel that holds each point; null off the raster."""
    x0, dx, y0, dy = affine
    at = points.withColumns(
        {
            "_row": F.floor((F.lit(float(y0)) - F.col(y)) / F.lit(float(dy))),
            "_col": F.floor((F.col(x) - F.lit(float(x0))) / F.lit(float(dx))),
        }
    )
    px = pixels.select(
        F.col("row").cast("bigint").alias("_row"), F.col("col").cast("bigint").alias("_col"), F.col(value).alias(alias)
    )
    return at.join(px, ["_row", "_col"], "left").drop("_row", "_col")


# ---- polygons: one row per ring (poly_id, part_id, xs, ys) ----

RING = ["poly_id", "part_id", "_ring"]


def _edges() -> Column:
    """Consecutive corners of ring columns xs, ys; the ring is closed if open."""
    def edge(i: Column) -> Column:
        j = F.pmod(i + 1, F.size("xs"))
        return F.struct(
            F.get("xs", i).alias("x1"), F.get("ys", i).alias("y1"),
            F.get("xs", j).alias("x2"), F.get("ys", j).alias("y2"),
        )

    return F.transform(F.sequence(F.lit(0), F.size("xs") - 1), edge)


def _rings(polys: DataFrame) -> DataFrame:
    """Rings with a key of their own, so that rings of one name are told apart."""
    return polys.withColumn("_ring", F.xxhash64("poly_id", "part_id", "xs", "ys"))


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """On which side of the line from a to b the point p lies: 1, 0, -1."""
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _in_box(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))


def crossing_rings(rings: DataFrame) -> DataFrame:
    """``_ring`` of the rings (rows of finite corners with ``_ring``) that meet themselves: edges that cross, touch or run back.

    Edges are listed under the cells of a grid that they pass; the cell's side is the ring's mean edge, so a
    ring lists about four cells for each edge, however its edges are spread. Only edges of a
    common cell are tested, by the sides on which their ends lie. Repeated corners are no edges.
    """
    e = F.filter(_edges(), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    kept = rings.select("_ring", e.alias("_e")).withColumn("_n", F.size("_e"))
    span = F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"]))
    side = F.col("_side")
    flat = kept.withColumn("_side", span / F.col("_n")).select("_ring", "_n", "_side", F.posexplode("_e").alias("i", "e")).select("_ring", "_n", "_side", "i", "e.*")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    column = flat.withColumn("_cx", F.explode(F.sequence(F.floor(F.least(x1, x2) / side), F.floor(F.greatest(x1, x2) / side))))
    slope = F.coalesce(F.try_divide(y2 - y1, x2 - x1), F.lit(0.0))
    low, high = F.least(y1, y2), F.greatest(y1, y2)

    def at(x: Column) -> Column:
        return F.when(x1 == x2, F.lit(None)).otherwise(F.least(high, F.greatest(low, y1 + (x - x1) * slope)))

    # Where the edge enters and leaves the column, a little more for rounding.
    a, b = at(F.col("_cx") * side), at((F.col("_cx") + 1) * side)
    bottom, top = F.coalesce(F.least(a, b), low) - side / 1024, F.coalesce(F.greatest(a, b), high) + side / 1024
    listed = column.withColumn("_cy", F.explode(F.sequence(F.floor(bottom / side), F.floor(top / side))))
    second = listed.select("_ring", "_cx", "_cy", F.col("i").alias("j"), *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    p, q, r, s = (x1, y1), (x2, y2), (F.col("bx1"), F.col("by1")), (F.col("bx2"), F.col("by2"))
    o1, o2, o3, o4 = _side(*p, *q, *r), _side(*p, *q, *s), _side(*r, *s, *p), _side(*r, *s, *q)
    cross = (o1 * o2 < 0) & (o3 * o4 < 0)
    touch = reduce(lambda u, v: u | v, [
        (o == 0) & _in_box(*line, *spot) for o, line, spot in ((o1, (*p, *q), r), (o2, (*p, *q), s), (o3, (*r, *s), p), (o4, (*r, *s), q))
    ])

    def back(corner: tuple, one: tuple, other: tuple) -> Column:
        """Two edges from one corner that run the same way."""
        along = (one[0] - corner[0]) * (other[0] - corner[0]) + (one[1] - corner[1]) * (other[1] - corner[1])
        return (_side(*corner, *one, *other) == 0) & (along > 0)

    follows, closes = F.col("j") == F.col("i") + 1, (F.col("i") == 0) & (F.col("j") == F.col("_n") - 1)
    meets = F.when(follows, back(q, p, s)).when(closes, back(p, q, r)).otherwise(cross | touch)
    pairs = listed.join(second, ["_ring", "_cx", "_cy"]).where(F.col("i") < F.col("j"))
    # As an aggregate: the optimizer takes long over so large a join condition.
    return pairs.groupBy("_ring").agg(F.max(meets).alias("_meets")).where("_meets").select("_ring")


def valid_polygons(polys: DataFrame) -> DataFrame:
    """Rings with at least three distinct finite corners and an area that nowhere cross or touch themselves."""
    def finite(c: str) -> Column:
        return F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))

    area = F.aggregate(
        _edges(), F.lit(0.0), lambda acc, e: acc + (e["x1"] * e["y2"] - e["x2"] * e["y1"])
    )
    whole = _rings(
        polys.where(F.col("xs").isNotNull() & F.col("ys").isNotNull() & (F.size("xs") == F.size("ys")))
        .where(finite("xs") & finite("ys"))
        .where(area != 0)  # so there are three corners
    )
    # Written: it is read three times, and planned once instead of as often.
    whole = materialise(whole, "whole-rings")
    return whole.join(crossing_rings(whole), "_ring", "left_anti").select(*polys.columns)


def polygons_to_utm(polys: DataFrame) -> DataFrame:
    """Rings in degrees (xs = lon, ys = lat) to metres."""
    xy = F.zip_with("ys", "xs", lambda lat, lon: to_utm(lat, lon))
    return polys.withColumn("_xy", xy).withColumns({"xs": F.col("_xy.x"), "ys": F.col("_xy.y")}).drop("_xy")


# A slab of a ring holds about this many of its edges, if they are short.
EDGES_PER_SLAB = 16
# Steps around a point on a border: far below any map's resolution, far above
# the rounding of its coordinates.
STEP = 2.0**-24
AROUND = [(math.cos(math.pi * (k + 0.5) / 8), math.sin(math.pi * (k + 0.5) / 8)) for k in range(16)]
ALL_SIDES = 2 ** len(AROUND) - 1


def _ends() -> tuple[Column, Column, Column, Column]:
    return F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2")


def _meet_edges(points: DataFrame, x: str, y: str, polys: DataFrame, reach: float, bucket: float) -> DataFrame:
    """Distinct points with the edges, one a row, that matter to them: of each ring whose box, grown by ``reach``, holds the
    point, those at its height (or within reach of it) and not left of it.

    Each ring is cut into horizontal slabs of its own height, so that about 16 of its edges touch one and all slabs
    together list no more than a few rows for each edge. A point is in one slab; no row or task
    holds a whole ring.
    """
    # Used for boxes and for edges.
    rings = materialise(_rings(valid_polygons(polys)).select(*RING, "xs", "ys"), "rings")
    n, y0, y1 = F.size("xs"), F.array_min("ys"), F.array_max("ys")
    rise = F.aggregate(_edges(), F.lit(0.0), lambda acc, e: acc + F.abs(e["y2"] - e["y1"]))
    far = F.greatest(F.lit(1.0), *[F.abs(f(c)) for f in (F.array_min, F.array_max) for c in ("xs", "ys")])
    framed = rings.select(
        *RING, "xs", "ys", y0.alias("_y0"), F.greatest((y1 - y0) * EDGES_PER_SLAB / n, rise / (4 * n), F.lit(2.0 * reach)).alias("_h"),
        # Room for the steps around a point.
        (F.lit(float(reach)) + far * F.lit(4 * STEP)).alias("_pad"),
    )
    x0, x1 = F.array_min("xs") - F.col("_pad"), F.array_max("xs") + F.col("_pad")
    boxes = _bucket_boxes(framed, x0, x1, y0 - F.col("_pad"), y1 + F.col("_pad"), bucket).select(*RING, "_y0", "_h", x0.alias("_x0"), x1.alias("_x9"), "_bx", "_by")
    spots = _bucket_points(points.select(x, y).distinct(), x, y, bucket)
    near = _bucket_join(spots, boxes).where(F.col(x).between(F.col("_x0"), F.col("_x9")))
    near = near.select(x, y, *RING, F.floor((F.col(y) - F.col("_y0")) / F.col("_h")).alias("_slab"))

    edges = framed.select("_ring", "_y0", "_h", "_pad", F.explode(_edges()).alias("e")).select("*", *[F.col(f"e.{c}").alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    ax, ay, bx, by = _ends()

    def slab(v: Column) -> Column:
        return F.floor((v - F.col("_y0")) / F.col("_h"))

    edges = edges.withColumn("_slab", F.explode(F.sequence(slab(F.least(ay, by) - F.col("_pad")), slab(F.greatest(ay, by) + F.col("_pad")))))
    edges = edges.select("_ring", "_slab", "_x1", "_y1", "_x2", "_y2", (F.greatest(ax, bx) + F.col("_pad")).alias("_right"))
    return near.join(edges, ["_ring", "_slab"]).where(F.col(x) <= F.col("_right"))


def _crosses(x: Column, y: Column) -> Column:
    """Whether the edge crosses the ray from a point to the right."""
    x1, y1, x2, y2 = _ends()
    at = x1 + F.try_divide((x2 - x1) * (y - y1), y2 - y1)
    return ((y1 > y) != (y2 > y)) & F.coalesce(x < at, F.lit(False))


def _on_edge(x: Column, y: Column) -> Column:
    x1, y1, x2, y2 = _ends()
    return (_side(x1, y1, x2, y2, x, y) == 0) & _in_box(x1, y1, x2, y2, x, y)


def _edge_distance(x: Column, y: Column) -> Column:
    x1, y1, x2, y2 = _ends()
    dx, dy = x2 - x1, y2 - y1
    along = F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(along, F.lit(0.0))))
    return euclid(x, y, x1 + t * dx, y1 + t * dy)


def _crossed_sides(x: Column, y: Column) -> Column:
    """One bit for each direction: whether the edge crosses the ray of the spot a step away. Only an edge close to the
    point or its ray is looked at from all sides; it is alike for all others."""
    x1, y1, x2, y2 = _ends()
    step = F.lit(STEP) * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
    slope = F.try_divide(x2 - x1, y2 - y1)
    close = (F.abs(y1 - y) <= 2 * step) | (F.abs(y2 - y) <= 2 * step) | F.coalesce(F.abs(x1 + slope * (y - y1) - x) <= 2 * step * (1 + F.abs(slope)), F.lit(False))
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(1 << k).alias("bit")) for k, (dx, dy) in enumerate(AROUND)])
    bits = F.aggregate(around, F.lit(0), lambda acc, d: acc + F.when(_crosses(x + step * d["dx"], y + step * d["dy"]), d["bit"]).otherwise(0))
    return F.when(close, bits).when(_crosses(x, y), F.lit(ALL_SIDES)).otherwise(0)


def _in_union(met: DataFrame, x: str, y: str, *more: Column) -> DataFrame:
    """Per point: ``_inside`` the dissolved polygons. Rings of one polygon cut
    holes into each other (even-odd), and a point on a border that two polygons
    share has one of them on every side. Crossings are summed per ring, so the parts of a ring need no order."""
    px, py = F.col(x), F.col(y)
    rings = met.groupBy(x, y, *RING).agg(
        F.bit_xor(_crossed_sides(px, py)).alias("_sides"), F.bit_xor(F.when(_crosses(px, py), F.lit(ALL_SIDES)).otherwise(0)).alias("_odd"), F.max(_on_edge(px, py)).alias("_border"), *more
    )
    kept = [F.min(c).alias(c) for c in rings.columns if c not in (x, y, *RING, "_sides", "_odd", "_border")]
    # Only a point on the ring itself differs from side to side.
    sides = rings.groupBy(x, y, "poly_id").agg(F.bit_xor(F.when(F.col("_border"), F.col("_sides")).otherwise(F.col("_odd"))).alias("_sides"), *kept)
    return sides.groupBy(x, y).agg((F.bit_or("_sides") == ALL_SIDES).alias("_inside"), *kept)


def within_polygon(df: DataFrame, x: str, y: str, polys: DataFrame, bucket: float = 0.1) -> DataFrame:
    """Rows strictly inside the dissolved polygons: holes are out, and so are
    points on an outer border.

    The test runs once per distinct coordinate. The matching coordinates are
    written out, so a short list is broadcast and the rows are not shuffled.
    """
    hits = _in_union(_meet_edges(df, x, y, polys, 0.0, bucket), x, y).where("_inside")
    return df.join(materialise(hits.select(x, y).distinct(), "inside"), [x, y], "left_semi").select(*df.columns)


def within_distance_of_polygon(
    df: DataFrame, x: str, y: str, polys: DataFrame, distance: float,
    region: DataFrame | None = None, bucket: float = 5000.0,
) -> DataFrame:
    """Rows inside the dissolved polygons or at most ``distance`` from its border, and inside
    the region. Everything in the same metric projection."""
    met = _meet_edges(df, x, y, polys, distance, bucket)
    near = _in_union(met, x, y, F.min(_edge_distance(F.col(x), F.col(y))).alias("_far"))
    near = near.where(F.col("_inside") | (F.col("_far") <= F.lit(float(distance))))
    kept = df.join(materialise(near.select(x, y).distinct(), "near"), [x, y], "left_semi").select(*df.columns)
    return kept if region is None else within_polygon(kept, x, y, region, bucket)


# ---- nearest station ----

PYRAMID_BASE = 0.001  # degrees; the finest bucket
PYRAMID_LEVELS = 20  # 0.001 * 2**19 degrees exceed the globe


def _pyramid(df: DataFrame, a: str, b: str) -> DataFrame:
    levels = F.explode(F.sequence(F.lit(0), F.lit(PYRAMID_LEVELS - 1))).alias("_l")
    side = F.lit(PYRAMID_BASE) * F.pow(F.lit(2.0), F.col("_l"))
    return df.select("*", levels).withColumns(
        {"_ca": F.floor(F.col(a) / side), "_cb": F.floor(F.col(b) / side)}
    )


def _around(df: DataFrame) -> DataFrame:
    ring = F.sequence(F.lit(-1), F.lit(1))
    return (
        df.withColumn("_da", F.explode(ring)).withColumn("_db", F.explode(ring))
        .withColumns({"_ca": F.col("_ca") + F.col("_da"), "_cb": F.col("_cb") + F.col("_db")})
        .drop("_da", "_db")
    )


def nearest(locations: DataFrame, stations: DataFrame, name: str = "name") -> DataFrame:
    """The nearest station of each location by distance in degrees.

    ``locations(name, lat, lon)``, ``stations(weatherStation, lat, lon)``; ties
    go to the smaller station key. First a pyramid of buckets gives an upper
    bound from one station per bucket, then only stations in the 3 x 3 buckets
    at least that wide are compared. The result is exact.
    """
    st = stations.select("weatherStation", F.col("lat").alias("_sa"), F.col("lon").alias("_sb")).distinct()
    st = materialise(st, "stations")
    tower = _pyramid(st, "_sa", "_sb")
    keys = ["_l", "_ca", "_cb"]
    samples = tower.groupBy(*keys).agg(F.min(F.struct("_sa", "_sb")).alias("_s"))
    places = locations.select(name, "lat", "lon")
    dist = euclid(F.col("lat"), F.col("lon"), F.col("_s._sa"), F.col("_s._sb"))
    bound = (
        _around(_pyramid(places, "lat", "lon")).join(samples, keys)
        .groupBy(name, "lat", "lon").agg(F.min(dist).alias("_ub"))
    )
    level = F.ceil(F.log2(F.greatest(F.col("_ub"), F.lit(PYRAMID_BASE)) / F.lit(PYRAMID_BASE)))
    # One level up leaves room for rounding in the bound.
    level = F.least(level + 1, F.lit(PYRAMID_LEVELS - 1)).cast("int")
    wanted = _around(_pyramid(bound, "lat", "lon").where(F.col("_l") == level))
    exact = euclid(F.col("lat"), F.col("lon"), F.col("_sa"), F.col("_sb"))
    return (
        wanted.join(tower, keys)
        .groupBy(name, "lat", "lon")
        .agg(F.min(F.struct(exact.alias("dist"), F.col("weatherStation").alias("s"))).alias("_best"))
        .select(name, F.col("_best.s").alias("weatherStation"), F.col("_best.dist").alias("dist"))
    )


def k_nearest(locations: DataFrame, stations: DataFrame, k: int = 5, name: str = "name") -> DataFrame:
    """The ``k`` nearest stations of each location by distance in degrees: name, rank (from 1), weatherStation and dist.

    ``locations(name, lat, lon)``, ``stations(weatherStation, lat, lon)``; ties go to the smaller station key. A
    location has fewer rows only if there are fewer stations. Null or NaN coordinates take no part. A pyramid of buckets knows how many stations
    each holds and the box they lie in: the least distance within which boxes with k stations end bounds the k-th nearest, and
    only stations in the 3 x 3 buckets at least that wide are compared. The result is exact.
    """
    def known(df: DataFrame) -> DataFrame:
        # NaN is no key of a bucket; NaN >= everything.
        return df.where((F.abs("lat") <= 360) & (F.abs("lon") <= 360))

    st = known(stations.select("weatherStation", "lat", "lon").where("weatherStation IS NOT NULL")).distinct()
    # Of stations at one spot only the first k can be among the nearest.
    first = Window.partitionBy("lat", "lon").orderBy("weatherStation")
    st = st.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    st = materialise(st.select("weatherStation", F.col("lat").alias("_sa"), F.col("lon").alias("_sb")), "stations")
    places = materialise(known(locations.select(name, "lat", "lon")).distinct().withColumn("_place", F.monotonically_increasing_id()), "places")
    tower, keys = _pyramid(st, "_sa", "_sb"), ["_l", "_ca", "_cb"]
    boxes = tower.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_sa").alias("_a0"), F.max("_sa").alias("_a1"), F.min("_sb").alias("_b0"), F.max("_sb").alias("_b1")
    )

    def off(at: str, low: str, high: str) -> Column:
        return F.greatest(F.abs(F.col(at) - F.col(low)), F.abs(F.col(at) - F.col(high)))

    zero = F.lit(0.0)
    ends = _around(_pyramid(places, "lat", "lon")).join(boxes, keys).withColumn("_end", euclid(off("lat", "_a0", "_a1"), off("lon", "_b0", "_b1"), zero, zero))
    # At most nine buckets of one level, so no station counts twice.
    nine = F.sort_array(F.collect_list(F.struct("_end", "_n")))
    reached = F.aggregate(
        nine, F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("end")),
        lambda acc, b: F.struct((acc["n"] + b["_n"]).alias("n"), F.coalesce(acc["end"], F.when(acc["n"] + b["_n"] >= k, b["_end"])).alias("end")),
    )
    bounds = ends.groupBy("_place", "_l").agg(reached["end"].alias("_end")).groupBy("_place").agg(F.min("_end").alias("_ub"))
    level = F.ceil(F.log2(F.greatest(F.col("_ub"), F.lit(PYRAMID_BASE)) / F.lit(PYRAMID_BASE)))
    # One level up leaves room for rounding in the bound; without one, all stations are wanted.
    level = F.when(F.col("_ub").isNull(), PYRAMID_LEVELS - 1).otherwise(F.least(level + 1, F.lit(PYRAMID_LEVELS - 1))).cast("int")
    wanted = _around(_pyramid(places.join(bounds, "_place", "left"), "lat", "lon").where(F.col("_l") == level))
    exact = euclid(F.col("lat"), F.col("lon"), F.col("_sa"), F.col("_sb"))
    nearest_first = Window.partitionBy("_place").orderBy("dist", "weatherStation")
    return (
        wanted.join(tower, keys).withColumn("dist", exact).where(F.col("dist") <= F.coalesce("_ub", "dist") * (1 + 2.0**-40))
        .withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
        .select(name, "rank", "weatherStation", "dist")
    )
