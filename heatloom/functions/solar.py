"""Sun position (Michalsky 1988), refraction (Reda and Andreas 2004) and
direct radiation (DISC model, Maxwell 1987) as plain column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEA_LEVEL_HPA = 1013.25
# Fixed values of the DISC model.
SOLAR_CONSTANT = 1370.0
MAX_ZENITH = 87.0
MIN_COS_ZENITH = 0.065
MAX_AIRMASS = 12.0
CLEAR_KT = 0.6
DISC_A_CLOUDY = [0.512, -1.56, 2.286, -2.222]
DISC_B_CLOUDY = [0.37, 0.962]
DISC_C_CLOUDY = [-0.28, 0.932, -2.048]
DISC_A_CLEAR = [-5.743, 21.77, -27.49, 11.56]
DISC_B_CLEAR = [41.4, -118.5, 66.05, 31.9]
DISC_C_CLEAR = [-47.01, 184.2, -222.0, 73.81]
DISC_KNC = [0.866, -0.122, 0.0121, -0.000653, 0.000014]


def _poly(coefficients: list[float], x: Column) -> Column:
    """Horner form of a polynomial given from the constant term up."""
    return reduce(lambda acc, k: acc * x + F.lit(k), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def _epoch_seconds(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / F.lit(1e6)


def sun_position(
    df: DataFrame,
    time: str = "time",
    lat: str = "latitude",
    lon: str = "longitude",
    temperature: str = "airTemperature",
    shift_minutes: int = 30,
    pressure_hpa: float = SEA_LEVEL_HPA,
) -> DataFrame:
    """Adds sunAzimuth, sunElevation and apparentZenith (degrees).

    The sun is taken in the middle of the hour that starts at ``time``. Each
    step is its own projection so that Catalyst evaluates shared terms once.
    """
    seconds = _epoch_seconds(F.col(time)) + F.lit(60.0 * shift_minutes)
    phi = F.radians(F.col(lat).cast("double"))
    out = (
        # Days since 2000-01-01 12:00 UTC, which is epoch second 946728000.
        df.withColumn("_n", (seconds - F.lit(946728000.0)) / F.lit(86400.0))
        .withColumn("_ut", F.pmod(seconds / F.lit(3600.0), F.lit(24.0)))
        .withColumn("_g", F.radians(F.lit(357.528) + F.lit(0.9856003) * F.col("_n")))
        .withColumn(
            "_lambda",
            F.radians(
                F.lit(280.460) + F.lit(0.9856474) * F.col("_n")
                + F.lit(1.915) * F.sin("_g") + F.lit(0.020) * F.sin(F.col("_g") * 2.0)
            ),
        )
        .withColumn("_eps", F.radians(F.lit(23.439) - F.lit(4e-7) * F.col("_n")))
        .withColumn("_ra", F.atan2(F.cos("_eps") * F.sin("_lambda"), F.cos("_lambda")))
        .withColumn("_delta", F.asin(F.sin("_eps") * F.sin("_lambda")))
        .withColumn("_gmst", F.lit(6.697375) + F.lit(0.0657098242) * F.col("_n") + F.col("_ut"))
        .withColumn(
            "_h", F.radians(F.lit(15.0) * F.col("_gmst") + F.col(lon).cast("double")) - F.col("_ra")
        )
        .withColumn(
            "sunElevation",
            F.degrees(
                F.asin(F.sin("_delta") * F.sin(phi) + F.cos("_delta") * F.cos(phi) * F.cos("_h"))
            ),
        )
        .withColumn(
            "sunAzimuth",
            F.pmod(
                F.degrees(
                    F.atan2(
                        -F.cos("_delta") * F.sin("_h"),
                        F.sin("_delta") * F.cos(phi) - F.cos("_delta") * F.sin(phi) * F.cos("_h"),
                    )
                ),
                F.lit(360.0),
            ),
        )
    )
    el = F.col("sunElevation")
    bend = (
        F.lit(pressure_hpa / 1010.0)
        * F.try_divide(F.lit(283.0), F.lit(273.0) + F.col(temperature))
        * F.lit(1.02)
        / (F.lit(60.0) * F.tan(F.radians(el + F.lit(10.3) / (el + F.lit(5.11)))))
    )
    refraction = F.when(el >= -0.8333667, bend).otherwise(0.0)
    return out.withColumn("apparentZenith", F.lit(90.0) - el - refraction).drop(
        "_n", "_ut", "_g", "_lambda", "_eps", "_ra", "_delta", "_gmst", "_h"
    )


def extra_radiation(doy: Column) -> Column:
    """Radiation outside the atmosphere on a day of the year."""
    day = F.lit(2 * math.pi / 365) * (doy - F.lit(1))
    return F.lit(SOLAR_CONSTANT) * (
        F.lit(1.00011) + F.lit(0.034221) * F.cos(day) + F.lit(0.00128) * F.sin(day)
        + F.lit(0.000719) * F.cos(day * 2.0) + F.lit(0.000077) * F.sin(day * 2.0)
    )


def disc_dni(ghi: Column, zenith: Column, doy: Column) -> Column:
    """Direct normal radiation from global radiation and apparent zenith."""
    cos_z = F.cos(F.radians(zenith))
    extra = extra_radiation(doy)
    kt = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ghi / (extra * F.greatest(cos_z, F.lit(MIN_COS_ZENITH)))))
    # The power has a positive base for every zenith that is kept.
    depth = F.greatest(F.lit(93.885) - zenith, F.lit(1.0))
    airmass = F.least(
        F.lit(MAX_AIRMASS),
        F.try_divide(F.lit(1.0), cos_z + F.lit(0.15) * F.pow(depth, F.lit(-1.253))),
    )
    cloudy = kt <= CLEAR_KT
    a = F.when(cloudy, _poly(DISC_A_CLOUDY, kt)).otherwise(_poly(DISC_A_CLEAR, kt))
    b = F.when(cloudy, _poly(DISC_B_CLOUDY, kt)).otherwise(_poly(DISC_B_CLEAR, kt))
    c = F.when(cloudy, _poly(DISC_C_CLOUDY, kt)).otherwise(_poly(DISC_C_CLEAR, kt))
    dni = extra * (_poly(DISC_KNC, airmass) - (a + b * F.exp(c * airmass)))
    return F.when((zenith > MAX_ZENITH) | (ghi < 0) | (dni < 0), F.lit(0.0)).otherwise(dni)


def diffuse(ghi: Column, dni: Column, zenith: Column) -> Column:
    return ghi - dni * F.cos(F.radians(zenith))


def with_radiation(df: DataFrame, time: str = "time", ghi: str = "GHI", shift_minutes: int = 30) -> DataFrame:
    """Adds DNI and DHI from global radiation and ``apparentZenith``."""
    middle = F.col(time) + F.expr(f"INTERVAL {shift_minutes} MINUTE")
    return (
        df.withColumn("DNI", disc_dni(F.col(ghi), F.col("apparentZenith"), F.dayofyear(middle)))
        .withColumn("DHI", diffuse(F.col(ghi), F.col("DNI"), F.col("apparentZenith")))
    )
