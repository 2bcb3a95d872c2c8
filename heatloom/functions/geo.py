"""Projection to UTM, distances and cell bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The GRS80 ellipsoid and UTM scale, offset and zone 31 meridian.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0
ZONE_31_MERIDIAN = 3.0

_N = FLATTENING / (2 - FLATTENING)
_A = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Coefficients of the Krueger series up to the third order.
_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
]
_C = 2 * math.sqrt(_N) / (1 + _N)


def _conformal(lat: Column) -> Column:
    sin_lat = F.sin(F.radians(lat))
    return F.sinh(F.atanh(sin_lat) - F.lit(_C) * F.atanh(F.lit(_C) * sin_lat))


def _xi_eta(t: Column, lon: Column, meridian: float) -> tuple[Column, Column]:
    d_lon = F.radians(lon - F.lit(meridian))
    return F.atan2(t, F.cos(d_lon)), F.atanh(F.sin(d_lon) / F.sqrt(F.lit(1.0) + t * t))


def _east_north(xi: Column, eta: Column) -> tuple[Column, Column]:
    east, north = eta, xi
    for j, alpha in enumerate(_ALPHA, start=1):
        a, b = xi * F.lit(2.0 * j), eta * F.lit(2.0 * j)
        east = east + F.lit(alpha) * F.cos(a) * F.sinh(b)
        north = north + F.lit(alpha) * F.sin(a) * F.cosh(b)
    return F.lit(FALSE_EASTING) + F.lit(UTM_SCALE * _A) * east, F.lit(UTM_SCALE * _A) * north


def to_utm(lat: Column, lon: Column, meridian: float = ZONE_31_MERIDIAN) -> Column:
    """struct<x, y> in metres for coordinates in degrees."""
    x, y = _east_north(*_xi_eta(_conformal(lat), lon, meridian))
    return F.struct(x.alias("x"), y.alias("y"))


def with_utm(df: DataFrame, lat: str, lon: str, x: str = "x", y: str = "y",
             meridian: float = ZONE_31_MERIDIAN) -> DataFrame:
    """Adds metric columns. Shared terms are their own projections, so they are
    computed once per row."""
    xi, eta = _xi_eta(F.col("_t"), F.col(lon), meridian)
    east, north = _east_north(F.col("_xi"), F.col("_eta"))
    staged = df.withColumn("_t", _conformal(F.col(lat))).withColumns({"_xi": xi, "_eta": eta})
    return staged.withColumns({x: east, y: north}).drop("_t", "_xi", "_eta")


def bbox_to_utm(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Two transformed corners, reordered so that min <= max."""
    a, b = to_utm(ymin, xmin), to_utm(ymax, xmax)
    return F.struct(
        F.least(a["x"], b["x"]).alias("xmin"),
        F.least(a["y"], b["y"]).alias("ymin"),
        F.greatest(a["x"], b["x"]).alias("xmax"),
        F.greatest(a["y"], b["y"]).alias("ymax"),
    )


def euclid(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    da, db = a1 - a2, b1 - b2
    return F.sqrt(da * da + db * db)


def cell_bounds(x: Column, y: Column, size: float, shape: str = "square") -> Column:
    """Bounds of the cell around a centre.

    A square has side ``size``; a circle has radius ``size`` and the bounds are
    its bounding box.
    """
    if shape not in ("square", "circle"):
        raise ValueError(f"a cell is a square or a circle, not {shape!r}")
    half = F.lit(size / 2 if shape == "square" else float(size))
    return F.struct(
        (x - half).alias("x0"), (x + half).alias("x1"), (y - half).alias("y0"), (y + half).alias("y1")
    )
