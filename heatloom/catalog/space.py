"""Cells, rasters and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial, tables
from . import views as v
from .heatstress import A3_SQL, building_cells
from .registry import query, r6, rounded, sql_r6

HALF = 50.0
X0, DX, Y0, DY = v.AFFINE
CENTRES = v.RASTER + f""", px AS (SELECT *, {X0}::double + (col + 0.5::double) * {DX}::double AS px, {Y0}::double - ("row" + 0.5::double) * {DY}::double AS py FROM raster)"""

# Three rings per region: a concave one, a triangle and one without area.
POLYS = """corner AS (SELECT r_regionkey AS poly_id, 41.2::double + 0.07::double * r_regionkey AS a, 1.9::double + 0.09::double * r_regionkey AS b FROM region),
ring AS (
  SELECT poly_id, 0 AS part_id, [b, b + 0.2, b + 0.2, b + 0.1, b] AS xs, [a, a, a + 0.15, a + 0.05, a + 0.15] AS ys FROM corner
  UNION ALL SELECT poly_id, 1, [b, b + 0.1, b], [a + 0.2, a + 0.2, a + 0.28] FROM corner),
edge AS (SELECT poly_id, part_id, xs[i] AS x1, ys[i] AS y1, xs[i % len(xs) + 1] AS x2, ys[i % len(xs) + 1] AS y2
  FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM ring))"""


def polys(s, d):
    corner = v.table(s, d, "region").selectExpr(
        "r_regionkey AS poly_id", "41.2D + 0.07D * r_regionkey AS a", "1.9D + 0.09D * r_regionkey AS b"
    )
    concave = corner.selectExpr("poly_id", "0 AS part_id", "array(b, b + 0.2D, b + 0.2D, b + 0.1D, b) AS xs", "array(a, a, a + 0.15D, a + 0.05D, a + 0.15D) AS ys")
    triangle = corner.selectExpr("poly_id", "1 AS part_id", "array(b, b + 0.1D, b) AS xs", "array(a + 0.2D, a + 0.2D, a + 0.28D) AS ys")
    flat = corner.selectExpr("poly_id", "2 AS part_id", "array(b, b + 1D, b + 2D) AS xs", "array(a, a, a) AS ys")
    broken = corner.selectExpr("poly_id", "3 AS part_id", "array(b, double('NaN'), b + 2D) AS xs", "array(a, a, a + 1D) AS ys")
    return tables.union_all(concave, triangle, flat, broken)


# Besides: two squares with a common border and grid points on it, a hole in one of them, and a ring that crosses itself.
DISTRICTS = POLYS + """, base AS (SELECT r_regionkey AS r, 0.07::double * r_regionkey AS da, 0.09::double * r_regionkey AS db FROM region),
box AS (SELECT r + 100 AS poly_id, 0 AS part_id, 0.005::double AS w, 0.105::double AS e, 0.005::double AS s, 0.105::double AS n, da, db FROM base
  UNION ALL SELECT r + 100, 1, 0.035, 0.065, 0.035, 0.065, da, db FROM base UNION ALL SELECT r + 200, 0, 0.105, 0.205, 0.005, 0.105, da, db FROM base),
sides AS (SELECT poly_id, part_id, round(1.9::double + db + w, 3) AS w, round(1.9::double + db + e, 3) AS e, round(41.2::double + da + s, 3) AS s, round(41.2::double + da + n, 3) AS n FROM box),
every AS (SELECT poly_id, part_id, xs, ys FROM ring UNION ALL SELECT poly_id, part_id, [w, e, e, w], [s, s, n, n] FROM sides
  UNION ALL SELECT poly_id + 300, 0, [b, b + 0.2, b + 0.2, b], [a, a + 0.15, a, a + 0.05] FROM corner),
num AS (SELECT poly_id, part_id, i, len(xs) AS n, xs[i] AS x1, ys[i] AS y1, xs[i % len(xs) + 1] AS x2, ys[i % len(xs) + 1] AS y2 FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM every)),
crossed AS (SELECT DISTINCT p.poly_id, p.part_id FROM num p JOIN num q ON p.poly_id = q.poly_id AND p.part_id = q.part_id AND p.i < q.i
  WHERE ((p.x2 - p.x1) * (q.y1 - p.y1) - (p.y2 - p.y1) * (q.x1 - p.x1)) * ((p.x2 - p.x1) * (q.y2 - p.y1) - (p.y2 - p.y1) * (q.x2 - p.x1)) < 0
    AND ((q.x2 - q.x1) * (p.y1 - q.y1) - (q.y2 - q.y1) * (p.x1 - q.x1)) * ((q.x2 - q.x1) * (p.y2 - q.y1) - (q.y2 - q.y1) * (p.x2 - q.x1)) < 0),
sound AS (SELECT * FROM every ANTI JOIN crossed USING (poly_id, part_id)), line AS (SELECT * FROM num ANTI JOIN crossed USING (poly_id, part_id))"""


def districts(s, d):
    base = v.table(s, d, "region").selectExpr("r_regionkey AS r", "0.07D * r_regionkey AS da", "0.09D * r_regionkey AS db")
    box = tables.union_all(
        base.selectExpr("r + 100 AS poly_id", "0 AS part_id", "0.005D AS w", "0.105D AS e", "0.005D AS s", "0.105D AS n", "da", "db"),
        base.selectExpr("r + 100 AS poly_id", "1 AS part_id", "0.035D AS w", "0.065D AS e", "0.035D AS s", "0.065D AS n", "da", "db"),
        base.selectExpr("r + 200 AS poly_id", "0 AS part_id", "0.105D AS w", "0.205D AS e", "0.005D AS s", "0.105D AS n", "da", "db"),
    )
    sides = box.selectExpr("poly_id", "part_id", "round(1.9D + db + w, 3) AS w", "round(1.9D + db + e, 3) AS e", "round(41.2D + da + s, 3) AS s", "round(41.2D + da + n, 3) AS n")
    squares = sides.selectExpr("poly_id", "part_id", "array(w, e, e, w) AS xs", "array(s, s, n, n) AS ys")
    corner = base.selectExpr("r + 300 AS poly_id", "41.2D + da AS a", "1.9D + db AS b")
    bow = corner.selectExpr("poly_id", "0 AS part_id", "array(b, b + 0.2D, b + 0.2D, b) AS xs", "array(a, a + 0.15D, a, a + 0.05D) AS ys")
    return tables.union_all(polys(s, d), squares, bow)


# Off a ring, a point is in it or not; on it, that holds for each of the spots around it. Rings of a polygon cancel out,
# polygons add up, and a point is inside if all its spots are.
INSIDE = """pts AS (SELECT DISTINCT lat, lon FROM grid), own AS (
  SELECT lat, lon, poly_id, part_id, count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND lon < x1 + (x2 - x1) * (lat - y1) / (y2 - y1)) % 2 AS odd,
    bool_or((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS border
  FROM pts, line GROUP BY 1, 2, 3, 4),
spots AS (SELECT *, lat + 1e-6 * sin((k + 0.3) * pi() / 10) AS py, lon + 1e-6 * cos((k + 0.3) * pi() / 10) AS px FROM own, range(20) t(k) WHERE border),
around AS (SELECT lat, lon, poly_id, part_id, k, count(*) FILTER (WHERE (y1 > py) <> (y2 > py) AND px < x1 + (x2 - x1) * (py - y1) / (y2 - y1)) % 2 AS odd
  FROM spots JOIN line USING (poly_id, part_id) GROUP BY ALL
  UNION ALL SELECT lat, lon, poly_id, part_id, k, odd FROM own, range(20) t(k) WHERE NOT border),
hit AS (SELECT DISTINCT lat, lon, k FROM (SELECT lat, lon, k FROM around GROUP BY lat, lon, k, poly_id HAVING sum(odd) % 2 = 1)),
inside AS (SELECT lat, lon FROM hit GROUP BY lat, lon HAVING count(*) = 20)"""


@query("p7_within_polygon", f"WITH {v.GRID}, {DISTRICTS}, {INSIDE} SELECT c_custkey, lat, lon FROM grid JOIN inside USING (lat, lon)")
def _(s, d):
    return spatial.within_polygon(v.grid(s, d), "lon", "lat", districts(s, d)).select("c_custkey", "lat", "lon")


@query("a11_union_of_polygons", f"WITH {v.GRID}, {DISTRICTS}, {INSIDE} SELECT lat, lon, EXISTS (SELECT 1 FROM inside i WHERE i.lat = pts.lat AND i.lon = pts.lon) AS covered FROM pts")
def _(s, d):
    pts = v.grid(s, d).select("lat", "lon").distinct()
    hit = spatial.within_polygon(pts, "lon", "lat", districts(s, d)).withColumn("covered", F.lit(True))
    return pts.join(hit, ["lat", "lon"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


# Metric copies of the grid and rings; the shift keeps points off the borders.
METRIC = """m AS (SELECT c_custkey, lon * 83000 AS x, lat * 111000 AS y FROM grid),
medge AS (SELECT poly_id, part_id, x1 * 83000 + 17.3::double AS x1, y1 * 111000 AS y1, x2 * 83000 + 17.3::double AS x2, y2 * 111000 AS y2 FROM edge),
d AS (SELECT c_custkey, poly_id, part_id, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (x2 - x1) * (y - y1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1 AS odd,
  min(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2)) AS dist
  FROM (SELECT *, least(1, greatest(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM m, medge) GROUP BY 1, 2, 3)"""


@query("p8_within_distance_of_polygon", f"""WITH {v.GRID}, {POLYS}, {METRIC} SELECT DISTINCT c_custkey FROM d WHERE poly_id < 2 AND (odd OR dist <= 5000)
  AND c_custkey IN (SELECT c_custkey FROM d WHERE poly_id >= 1 AND odd)""")
def _(s, d):
    grid = v.grid(s, d).selectExpr("c_custkey", "lon * 83000 AS x", "lat * 111000 AS y")
    metric = spatial.valid_polygons(polys(s, d)).withColumns(
        {"xs": F.transform("xs", lambda x: x * 83000 + 17.3), "ys": F.transform("ys", lambda y: y * 111000)}
    )
    near, region = metric.where("poly_id < 2"), metric.where("poly_id >= 1")
    return spatial.within_distance_of_polygon(grid, "x", "y", near, 5000.0, region).select("c_custkey")


@query("p9_valid_polygons", f"WITH {DISTRICTS} SELECT poly_id, part_id, CAST(len(xs) AS BIGINT) AS corners FROM sound")
def _(s, d):
    return spatial.valid_polygons(districts(s, d)).select("poly_id", "part_id", F.size("xs").cast("bigint").alias("corners"))


@query("j10_points_in_cells", f"""WITH {v.BUILDINGS}, {v.CELLS} SELECT building_reference, cell FROM buildings b JOIN cells c ON abs(b.bx - c.x) < 50 AND abs(b.by_ - c.y) < 50""")
def _(s, d):
    return building_cells(s, d).select("building_reference", "cell")


@query("j10_points_in_circles", f"""WITH {v.BUILDINGS}, {v.CELLS} SELECT building_reference, cell FROM buildings b JOIN cells c ON (b.bx - c.x) ** 2 + (b.by_ - c.y) ** 2 < 4900""")
def _(s, d):
    return spatial.points_in_cells(v.buildings(s, d), v.cells(s, d), 70.0, "bx", "by_", shape="circle").select("building_reference", "cell")


@query("j11_sample_raster", f"""WITH {v.CELLS}, {v.RASTER} SELECT cell, coalesce(value, -1) AS elevation FROM cells LEFT JOIN raster ON "row" = floor(({Y0} - y) / {DY}) AND col = floor((x - {X0}) / {DX})""")
def _(s, d):
    out = spatial.sample_raster(v.cells(s, d), v.raster(s, d), v.AFFINE)
    return out.select("cell", F.coalesce("elevation", F.lit(-1.0)).alias("elevation"))


@query("j12_pixels_in_cells", f"""WITH {v.CELLS}, {CENTRES} SELECT cell, "row", col, value FROM px JOIN cells ON abs(px - x) < 50 AND abs(py - y) < 50""")
def _(s, d):
    px = spatial.pixel_centres(v.raster(s, d), v.AFFINE)
    return spatial.points_in_cells(px, v.cells(s, d), HALF).select("cell", "row", "col", "value")


@query("a4_zonal_stats", f"""WITH {v.CELLS}, {CENTRES}, z AS (SELECT cell, min(value) AS lo, max(value) AS hi, avg(value) AS m FROM (SELECT * REPLACE (nullif(value, 0) AS value) FROM px) px JOIN cells ON abs(px - x) < 50 AND abs(py - y) < 50 GROUP BY cell)
SELECT cell, lo AS ndvi_min, hi AS ndvi_max, round(m, 6) AS ndvi_mean FROM cells LEFT JOIN z USING (cell)""")
def _(s, d):
    from ..functions.weather import null_if

    px = spatial.pixel_centres(v.raster(s, d), v.AFFINE).withColumn("value", null_if(F.col("value"), 0))
    return rounded(spatial.zonal_stats(v.cells(s, d), px, HALF, "cell").drop("x", "y"), "ndvi_mean")


@query("j13_left_fill_zero", A3_SQL.replace("SELECT cell, round(sum", ", z AS (SELECT cell, round(sum").replace("GROUP BY cell", "GROUP BY cell)") +
       " SELECT cell, coalesce(area_a, 0) AS area_a, coalesce(floors, 0) AS floors FROM cells LEFT JOIN z USING (cell)")
def _(s, d):
    agg = spatial.cell_attributes(building_cells(s, d), "cell", ["area_a"], ["floors"])
    out = spatial.left_fill_zero(v.cells(s, d).select("cell"), agg, "cell")
    return out.select("cell", (F.round("area_a", 2) + 0.0).alias("area_a"), F.round("floors", 6).alias("floors"))


@query("s14_crop_raster", f"""WITH {CENTRES} SELECT "row", col, px, py, value FROM px WHERE px BETWEEN 500 AND 1500 AND py BETWEEN 1000 AND 2700""")
def _(s, d):
    return spatial.crop_pixels(v.raster(s, d), v.AFFINE, (500.0, 1000.0, 1500.0, 2700.0)).select("row", "col", "px", "py", "value")
