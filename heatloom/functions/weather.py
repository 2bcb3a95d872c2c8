"""Unit conversions, humidity and wind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zero Celsius in Kelvin, the two Magnus coefficients.
ZERO_CELSIUS = 273.15
MAGNUS_A = 17.67
MAGNUS_B = 243.5


def kelvin_to_celsius(c: Column) -> Column:
    return c - F.lit(ZERO_CELSIUS)


def wind_speed(east: Column, north: Column) -> Column:
    return F.sqrt(east * east + north * north)


def wind_direction(east: Column, north: Column) -> Column:
    """Degrees the wind comes from, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(east, north)) + F.lit(180.0), F.lit(360.0))


def _magnus(t: Column) -> Column:
    return F.exp(F.try_divide(F.lit(MAGNUS_A) * t, t + F.lit(MAGNUS_B)))


def relative_humidity(temperature: Column, dew_point: Column) -> Column:
    """Relative humidity as a fraction; null when an input is null."""
    return F.try_divide(_magnus(dew_point), _magnus(temperature))


def to_percent(c: Column) -> Column:
    return c * F.lit(100.0)


def nan_to_null(c: Column) -> Column:
    """NaN counts as a value in Spark aggregates and is larger than any number."""
    return F.nullif(c, F.lit(float("nan")))


def quantile_scale(x: Column, lo: Column, hi: Column) -> Column:
    """Scale so that [lo, hi] becomes [0, 1]; no clipping; null when lo = hi."""
    return F.try_divide(x - lo, hi - lo)


def quantile_unscale(p: Column, lo: Column, hi: Column) -> Column:
    return p * (hi - lo) + lo


def null_if(c: Column, nodata) -> Column:
    return F.nullif(c, F.lit(nodata).cast("double"))


def scale_vegetation(c: Column) -> Column:
    """Raster values 0..200 to a vegetation index -1..1; null outside."""
    scaled = c / F.lit(200.0) * F.lit(2.0) - F.lit(1.0)
    return F.when(scaled.between(-1.0, 1.0), scaled)
