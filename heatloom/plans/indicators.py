"""Heat-stress indicators from hourly temperature and humidity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weather import nan_to_null
from ..operators.heat import daily_stats, heat_flags, with_heat_index, yearly_counts


def daily_heat(weather: DataFrame, lookup: DataFrame, keys: Sequence[str] = ("weatherStation",)) -> DataFrame:
    """Day and night heat index per date. The hourly rows are reduced to
    (date, station) before anything is shuffled."""
    clean = weather.withColumns({c: nan_to_null(F.col(c)) for c in ("airTemperature", "relativeHumidity")})
    return daily_stats(with_heat_index(clean, lookup), keys=keys)


def yearly_heat(weather: DataFrame, lookup: DataFrame, keys: Sequence[str] = ("weatherStation",)) -> DataFrame:
    """Flagged days per station and year."""
    return yearly_counts(heat_flags(daily_heat(weather, lookup, keys), keys), keys=keys)
