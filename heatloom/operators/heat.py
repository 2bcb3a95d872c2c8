"""Heat index from a lookup surface, daily extremes, flags and yearly counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import is_day, year_month
from ..functions.keys import station_lat, station_lon
from ..functions.weather import to_percent
from ..session import materialise
from .series import rolling_min
from .spatial import nearest
from .tables import isin_keys, label_keys

# Axes of the lookup surface (degrees Celsius, percent).
TDB_RANGE = (-20, 60)
RH_RANGE = (0, 100)

# Coefficients of the Rothfusz (1990) regression in Fahrenheit,
# for 1, T, R, TR, T2, R2, T2R, TR2, T2R2.
ROTHFUSZ = [
    -42.379, 2.04901523, 10.14333127, -0.22475541, -0.00683783,
    -0.05481717, 0.00122874, 0.00085282, -0.00000199,
]

# A surface of up to this many cells (known from its axes, about 10 MB) is broadcast.
SURFACE_CELLS = 200_000

# Flag thresholds.
HEAT_WAVE_DAYS = 3
HEAT_WAVE_LIMIT = 33
NIGHT_LIMITS = [("tropicalNight", 20), ("torridNight", 25), ("infernalNight", 30)]
BANDS = [
    ("safe", None, 27), ("caution", 27, 33), ("extremeCaution", 33, 41),
    ("hazardous", 41, 52), ("extremeHazardous", 52, 92), ("beyondHumanLimit", 92, None),
]


def heat_index(tdb: Column, rh: Column) -> Column:
    """Closed-form heat index in Celsius: the simple mean formula, and the
    regression where that exceeds 80 F."""
    t = tdb * F.lit(1.8) + F.lit(32.0)
    simple = (F.lit(0.5) * (t + F.lit(61.0) + (t - F.lit(68.0)) * F.lit(1.2) + rh * F.lit(0.094)) + t) / F.lit(2.0)
    terms = [F.lit(1.0), t, rh, t * rh, t * t, rh * rh, t * t * rh, t * rh * rh, t * t * rh * rh]
    regression = sum((F.lit(k) * x for k, x in zip(ROTHFUSZ[1:], terms[1:])), F.lit(ROTHFUSZ[0]))
    return (F.when(simple >= 80, regression).otherwise(simple) - F.lit(32.0)) / F.lit(1.8)


def build_lookup(
    spark: SparkSession,
    fn: Callable[[Column, Column], Column] = heat_index,
    tdb: Sequence[int] = TDB_RANGE,
    rh: Sequence[int] = RH_RANGE,
) -> DataFrame:
    """The lookup surface ``(tdb, rh, heat_index)`` for any column function."""
    width = rh[1] - rh[0] + 1
    points = spark.range((tdb[1] - tdb[0] + 1) * width)
    grid = points.select(
        (F.lit(tdb[0]) + F.floor(F.col("id") / width)).cast("int").alias("tdb"),
        (F.lit(rh[0]) + F.col("id") % width).cast("int").alias("rh"),
    )
    return grid.withColumn("heat_index", fn(F.col("tdb").cast("double"), F.col("rh").cast("double")))


def lookup_grid(lookup: DataFrame, rh_values: Sequence[int]) -> DataFrame:
    """The surface as a grid, one column per humidity."""
    return lookup.groupBy("tdb").pivot("rh", list(rh_values)).agg(F.max("heat_index"))


def _lookup_cells(lookup: DataFrame, nx: int, ny: int, x0: int, y0: int, z: str) -> DataFrame:
    """One row per unit cell with its four corner values: every lookup point is
    dealt to the cells it is a corner of."""
    corners = lookup.select(
        (F.col(lookup.columns[0]) - x0).alias("_i"), (F.col(lookup.columns[1]) - y0).alias("_j"), F.col(z).alias("_z")
    ).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    cells = corners.select(
        (F.col("_i") - F.floor(F.col("_k") / 2)).cast("int").alias("_i"),
        (F.col("_j") - F.col("_k") % 2).cast("int").alias("_j"),
        "_k", "_z",
    ).where(F.col("_i").between(0, nx - 2) & F.col("_j").between(0, ny - 2))
    return cells.groupBy("_i", "_j").agg(
        *[F.max(F.when(F.col("_k") == k, F.col("_z"))).alias(f"_z{k}") for k in range(4)]
    )


def bilinear(
    df: DataFrame, x: Column, y: Column, lookup: DataFrame, alias: str, z: str = "heat_index",
    x_range: Sequence[int] = TDB_RANGE, y_range: Sequence[int] = RH_RANGE,
) -> DataFrame:
    """Bilinear value of a unit-step surface; outside it the edge cell is
    extended linearly. Rows with a null or NaN coordinate get null."""
    nx, ny = x_range[1] - x_range[0] + 1, y_range[1] - y_range[0] + 1
    # One row per unit cell of the surface: the axes bound the size.
    cells = _lookup_cells(lookup, nx, ny, x_range[0], y_range[0], z)
    if (nx - 1) * (ny - 1) <= SURFACE_CELLS:
        cells = F.broadcast(cells)

    def cell(v: Column, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 2), F.floor(v))).cast("int")

    nan = F.lit(float("nan"))
    at = df.withColumns(
        {
            "_x": F.nullif(x.cast("double"), nan) - F.lit(x_range[0]),
            "_y": F.nullif(y.cast("double"), nan) - F.lit(y_range[0]),
        }
    ).withColumns({"_i": F.when(F.col("_x").isNotNull(), cell(F.col("_x"), nx)),
                   "_j": F.when(F.col("_y").isNotNull(), cell(F.col("_y"), ny))})
    u, v = F.col("_x") - F.col("_i"), F.col("_y") - F.col("_j")
    value = (
        F.col("_z0") * (1 - u) * (1 - v) + F.col("_z1") * (1 - u) * v
        + F.col("_z2") * u * (1 - v) + F.col("_z3") * u * v
    )
    return (
        at.join(cells, ["_i", "_j"], "left")
        .withColumn(alias, value)
        .drop("_x", "_y", "_i", "_j", "_z0", "_z1", "_z2", "_z3")
    )


def with_heat_index(df: DataFrame, lookup: DataFrame) -> DataFrame:
    return bilinear(df, F.col("airTemperature"), to_percent(F.col("relativeHumidity")), lookup, "heatIndex")


def day_and_night(df: DataFrame, value: str, time: str, *keep: Column | str) -> DataFrame:
    """The value as ``_night_v`` and ``_day_v``, null on the other side. Its own
    projection, so that value and hour are computed once per row."""
    v, day = F.col(value), is_day(F.col(time))
    return df.select(*keep, F.when(~day, v).alias("_night_v"), F.when(day, v).alias("_day_v"))


def side_aggregates() -> list[Column]:
    return [
        fn(f"_{side}_v").alias(f"{side}_temp_{name}")
        for side in ("night", "day") for name, fn in (("min", F.min), ("mean", F.avg), ("max", F.max))
    ]


def daily_stats(df: DataFrame, value: str = "heatIndex", keys: Sequence[str] = ("weatherStation",),
                time: str = "time") -> DataFrame:
    """Night and day min, mean and max per date and key in one aggregate; a
    side without hours is null."""
    sides = day_and_night(df, value, time, *keys, F.to_date(time).alias("date"))
    return sides.groupBy("date", *keys).agg(*side_aggregates())


def heat_flag_columns(rolling: str) -> dict[str, Column]:
    flags = {"heatWave": F.col(rolling) > HEAT_WAVE_LIMIT}
    for name, limit in NIGHT_LIMITS:
        flags[name] = F.col("night_temp_min") > limit
    for source, suffix in (("day_temp_max", "MaxTemperature"), ("day_temp_mean", "AverageTemperature")):
        c = F.col(source)
        for name, lo, hi in BANDS:
            bounds = ([c >= lo] if lo is not None else []) + ([c < hi] if hi is not None else [])
            flags[f"{name}{suffix}"] = bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1]
    return flags


FLAG_NAMES = list(
    ["heatWave"] + [n for n, _ in NIGHT_LIMITS]
    + [f"{n}{s}" for s in ("MaxTemperature", "AverageTemperature") for n, _, _ in BANDS]
)


def heat_flags(daily: DataFrame, keys: Sequence[str] = ("weatherStation",), date: str = "date") -> DataFrame:
    """The 16 flags of each day. NaN must be null before (see nan_to_null)."""
    rolled = rolling_min(daily, "day_temp_max", HEAT_WAVE_DAYS, keys, date)
    return rolled.withColumns(heat_flag_columns("rolling_min_day_temp_max"))


def yearly_counts(flags: DataFrame, names: Sequence[str] = tuple(FLAG_NAMES),
                  keys: Sequence[str] = ("weatherStation",), date: str = "date") -> DataFrame:
    """Flagged days per key and year; a null flag does not count."""
    return flags.groupBy(*keys, F.year(date).alias("year")).agg(*[F.count_if(n).alias(n) for n in names])


def degree_days(df: DataFrame, hdd: float = 18, cdd: float = 21, value: str = "airTemperature",
                keys: Sequence[str] = ("weatherStation",), time: str = "time") -> DataFrame:
    """Heating and cooling degree days per key and year from daily means."""
    daily = df.groupBy(*keys, F.to_date(time).alias("_date")).agg(F.avg(value).alias("_mean"))
    return daily.groupBy(*keys, F.year("_date").alias("year")).agg(
        F.sum(F.greatest(F.lit(0.0), F.lit(float(hdd)) - F.col("_mean"))).alias("HDD"),
        F.sum(F.greatest(F.lit(0.0), F.col("_mean") - F.lit(float(cdd)))).alias("CDD"),
    )


def station_table(df: DataFrame, key: str = "weatherStation") -> DataFrame:
    """Distinct stations with the coordinates their key holds."""
    return df.select(key).distinct().select(
        F.col(key).alias("weatherStation"), station_lat(F.col(key)).alias("lat"), station_lon(F.col(key)).alias("lon")
    )


def location_series(df: DataFrame, locations: DataFrame, lookup: DataFrame) -> DataFrame:
    """Hourly heat index at the station nearest to each location.

    The pairs are written out; their true size lets Spark broadcast them and
    drop all other stations without a shuffle.
    """
    near = materialise(nearest(locations, station_table(df)).drop("dist"), "nearest")
    labels = near.withColumnRenamed("name", "label")
    return with_heat_index(label_keys(isin_keys(df, "weatherStation", labels.select("weatherStation")), "weatherStation", labels), lookup)


def location_daily(df: DataFrame, locations: DataFrame, lookup: DataFrame) -> DataFrame:
    return daily_stats(location_series(df, locations, lookup), keys=("locationName",))


def slice_for_map(df: DataFrame, moment: str, ym: str = "ym") -> DataFrame:
    """The month of a moment and the month before it, with coordinates in
    place of the station key. ``ym`` is the partition column."""
    t = F.lit(moment).cast("timestamp_ntz")
    months = df.where((F.col(ym) == year_month(t)) | (F.col(ym) == year_month(F.add_months(t, -1))))
    key = F.col("weatherStation")
    return months.withColumns({"latitude": station_lat(key), "longitude": station_lon(key)}).drop("weatherStation")
