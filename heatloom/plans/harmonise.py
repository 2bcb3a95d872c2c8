"""Raw gridded weather to the harmonised table, history and forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import to_time
from ..functions.keys import station_key
from ..functions.solar import sun_position, with_radiation
from ..functions.weather import kelvin_to_celsius, relative_humidity, wind_direction, wind_speed
from ..operators.series import harmonise_series
from ..operators.tables import attach_coords, drop_nulls, join_variables, nan_columns_to_null, rename_present

# Raw name to harmonised name.
HISTORY_VARIABLES = {
    "u10": "windSpeedEast",
    "v10": "windSpeedNorth",
    "t2m": "airTemperature",
    "d2m": "dewAirTemperature",
    "lai_lv": "lowVegetationRatio",
    "lai_hv": "highVegetationRatio",
    "tp": "totalPrecipitation",
    "ssrd": "GHI",
    "fal": "albedo",
    "stl4": "soilTemperature",
    "swvl4": "soilWaterRatio",
}
FORECAST_VARIABLES = {
    "u": "windSpeedEast",
    "lat": "latitude",
    "lon": "longitude",
    "v": "windSpeedNorth",
    "temp": "airTemperature",
    "prec": "totalPrecipitation",
    "swflx": "GHI",
    "rh": "relativeHumidity",
}
# Bookkeeping columns of the raw history files.
HISTORY_EXTRAS = ["time", "step", "number", "surface", "depthBelowLandLayer", "time_right", "step_right", "number_right"]
# Variables replaced by the mean with the next hour.
FORECAST_MEANS = ["windSpeed", "windSpeedEast", "windSpeedNorth", "windDirection", "airTemperature", "relativeHumidity"]
HISTORY_MEANS = [
    "windSpeed", "windDirection", "soilTemperature", "dewAirTemperature", "airTemperature", "relativeHumidity",
    "windSpeedEast", "windSpeedNorth", "lowVegetationRatio", "highVegetationRatio", "albedo", "soilWaterRatio",
]


def _with_sun(df: DataFrame) -> DataFrame:
    lit = with_radiation(sun_position(df))
    return lit.drop("apparentZenith", "latitude", "longitude")


def _with_wind(df: DataFrame) -> DataFrame:
    east, north = F.col("windSpeedEast"), F.col("windSpeedNorth")
    return df.withColumns({"windSpeed": wind_speed(east, north), "windDirection": wind_direction(east, north)})


def _with_station(df: DataFrame) -> DataFrame:
    return df.withColumn("weatherStation", station_key(F.col("latitude"), F.col("longitude")))


def history_weather(df: DataFrame, batch_col: str | None = None, circular_wind: bool = False,
                    fix_last_unit: bool = False, **cut: int) -> DataFrame:
    """Wide raw history rows to the harmonised table.

    All variables of a station travel together, in one shuffle of the rows.
    """
    raw = drop_nulls(nan_columns_to_null(df)).drop(*HISTORY_EXTRAS)
    named = rename_present(raw, {"valid_time": "time", **HISTORY_VARIABLES})
    named = named.withColumn("time", to_time(F.col("time")))
    celsius = {c: kelvin_to_celsius(F.col(c)) for c in ("soilTemperature", "dewAirTemperature", "airTemperature")}
    derived = _with_station(_with_wind(named)).withColumns(celsius)
    derived = derived.withColumn(
        "relativeHumidity", relative_humidity(F.col("airTemperature"), F.col("dewAirTemperature"))
    )
    smooth = harmonise_series(
        derived, HISTORY_MEANS, ["weatherStation"], radiation="GHI", rain="totalPrecipitation", batch_col=batch_col,
        circular=["windDirection"] if circular_wind else [], fix_last_unit=fix_last_unit, **cut,
    )
    return _with_sun(smooth)


def forecast_weather(df: DataFrame, batch_col: str | None = None, circular_wind: bool = False,
                     **cut: int) -> DataFrame:
    """Wide raw forecast rows (with coordinates) to the harmonised table."""
    named = rename_present(df.drop("index"), FORECAST_VARIABLES)
    named = drop_nulls(nan_columns_to_null(named))
    named = named.withColumn("time", to_time(F.col("time")))
    derived = _with_station(_with_wind(named)).withColumn(
        "airTemperature", kelvin_to_celsius(F.col("airTemperature"))
    )
    smooth = harmonise_series(
        derived, FORECAST_MEANS, ["weatherStation"], batch_col=batch_col,
        circular=["windDirection"] if circular_wind else [], **cut,
    )
    return _with_sun(smooth)


def forecast_input(tables: list[DataFrame], coords: DataFrame) -> DataFrame:
    """Variable tables on (x, y, time) joined and given coordinates."""
    return attach_coords(join_variables(tables, ["x", "y", "time"], "inner"), coords)


def history_input(tables: list[DataFrame]) -> DataFrame:
    return join_variables(tables, ["latitude", "longitude", "valid_time"], "left")
