"""Static features, training and prediction on the fine grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import with_utm
from ..functions.keys import station_key
from ..functions.weather import null_if, scale_vegetation
from ..session import materialise
from ..operators.model import (
    NOT_USED, TARGETS, TRAINING, assemble_predictions, feature_columns, grid_features, normalise, predict, prepare_training,
    rmse, sample_times, split_times, train,
)
from ..operators.order import ecdf_rank, minmax_01, time_rank
from ..operators.spatial import (
    cell_attributes, crop_pixels, left_fill_zero, points_in_cells, sample_raster, zonal_stats,
)
from ..operators.tables import common_times
from ..sources.tables import static_store_columns

# Building attributes summed per cell, and the one averaged.
BUILDING_SUMS = [
    "building_area_commercial",
    "building_area_residential",
    "building_area_warehouse_parking",
    "building_area_offices",
    "building_area_singular_building",
    "building_area_cultural",
    "building_area_entertainment_venues",
    "building_area_industrial",
    "building_area_urbanization_and_landscaping_works_undeveloped_land",
    "building_area_leisure_and_hospitality",
    "building_area_sports_facilities",
    "building_area_religious",
    "building_area_healthcare_and_charity",
    "n_dwellings",
]
BUILDING_MEANS = ["n_floors_above_ground"]
# Computed columns that are not stored; 18 features stay.
NOT_STORED = ["building_area_urbanization_and_landscaping_works_undeveloped_land_percentile", "geometry"]
CELL_METRES = 100.0


def grid_cells(centres: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Cell key and metric centre of each grid point."""
    keyed = centres.select(station_key(F.col(lat), F.col(lon)).alias("weatherStation"), lat, lon)
    return with_utm(keyed, lat, lon).select("weatherStation", "x", "y")


def static_features(
    cells: DataFrame, elevation: DataFrame, elevation_affine: Sequence[float], buildings: DataFrame,
    vegetation: DataFrame, vegetation_affine: Sequence[float], vegetation_bbox: Sequence[float],
    sums: Sequence[str] = tuple(BUILDING_SUMS), means: Sequence[str] = tuple(BUILDING_MEANS),
    size: float = CELL_METRES, shape: str = "square",
) -> DataFrame:
    """All static features of ``cells(weatherStation, x, y)``, scaled to [0, 1].

    ``buildings(bx, by, attributes…)`` and the rasters are metric; raw
    vegetation values are 0..200. Cell tables are used several times each, so
    they are written out in between.
    """
    cells = materialise(cells.select("weatherStation", "x", "y"), "cells")
    half = size / 2 if shape == "square" else size
    key = "weatherStation"
    high = sample_raster(cells, elevation, elevation_affine).select(key, "elevation")
    high = ecdf_rank(high, ["elevation"], [key]).withColumnRenamed("elevation_percentile", "elevation")

    inside = points_in_cells(buildings, cells, half, "bx", "by", shape=shape)
    attributes = left_fill_zero(cells.select(key), cell_attributes(inside, key, sums, means), key)
    attributes = materialise(attributes, "cell-attributes")
    ranked = ecdf_rank(attributes, [*sums, *means], [key])

    green = crop_pixels(vegetation, vegetation_affine, vegetation_bbox)
    green = green.withColumn("value", null_if(scale_vegetation(F.col("value")), 0))
    zones = zonal_stats(cells, green, half, key).drop("x", "y")

    wide = materialise(high.join(ranked, key).join(zones, key), "cell-features")
    stored = static_store_columns(wide, NOT_STORED)
    return minmax_01(stored, [c for c in stored.columns if c != key])


def training_hours(hr: DataFrame, lr: DataFrame, n_hours: int = TRAINING["n_hours"]) -> DataFrame:
    """The first ``n_hours`` hours that both tables hold: the documented bound on training rows."""
    times = time_rank(common_times(hr, lr), "time", "_t")
    return times.where(F.col("_t") <= n_hours).select("time")


def fit_downscaling(
    hr: DataFrame, lr: DataFrame, static: DataFrame, variables: Sequence[str], stations: Sequence[str],
    params: dict | None = None, hours: DataFrame | None = None, validation_hours: int = 1000,
    test_ratio: float = 0.1, n_harmonics: int = 4, seed: int = 42, targets: Sequence[str] = tuple(TARGETS),
) -> tuple[PipelineModel, DataFrame, DataFrame, DataFrame]:
    """(model, errors, low-resolution statistics, high-resolution statistics).

    ``hours`` selects what is trained on; :func:`training_hours` gives the first
    N common hours. Whole hours are dealt to train, test and validation;
    validation hours pick the round and are not trained on. The rows are written once: boosting
    passes over them many times and must not recompute them.
    """
    rows, lr_stats, hr_stats = prepare_training(hr, lr, static, variables, stations, targets, hours, n_harmonics)
    rows = materialise(rows, "training-rows")
    parts = split_times(rows.select("time").distinct(), test_ratio, seed)
    held = sample_times(parts.where(~F.col("is_test")), validation_hours, seed + 1).withColumn("_held", F.lit(True))
    parts = parts.join(held, "time", "left").select("time", "is_test", F.coalesce("_held", F.lit(False)).alias("is_validation"))
    split = rows.join(materialise(parts, "training-times"), "time")
    variables = [v for v in variables if v not in NOT_USED]
    columns = feature_columns(static, variables, stations, n_harmonics)
    model = train(split.where(~F.col("is_test")), columns, targets, params, "is_validation")
    scored = predict(model, split).where(F.col("is_test") | F.col("is_validation"))
    pairs = {f"y_{t}": f"pred_{t}" for t in targets}
    errors = (
        rmse(scored.where("is_test"), pairs).withColumn("set", F.lit("test"))
        .unionByName(rmse(scored.where("is_validation"), pairs).withColumn("set", F.lit("validation")))
    )
    return model, errors, lr_stats, hr_stats


def predict_grid(
    model: PipelineModel, lr: DataFrame, static: DataFrame, lr_stats: DataFrame, hr_stats: DataFrame,
    variables: Sequence[str], stations: Sequence[str], n_harmonics: int = 4,
    targets: Sequence[str] = tuple(TARGETS), shards: int | None = None, run: Sequence[str] = (),
) -> DataFrame:
    """Predictions for every hour of ``lr`` on every cell of ``static``.

    Overlapping forecast runs are told apart by the columns ``run``, as
    ``("forecastingTime",)`` after :func:`forecast_runs`; they lead the result.
    """
    variables = [v for v in variables if v not in NOT_USED]
    x = normalise(lr, lr_stats, variables)
    features = grid_features(x, static, variables, stations, n_harmonics, shards=shards, run=run)
    return assemble_predictions(predict(model, features), hr_stats, targets, (*run, "time", "weatherStation"))


def station_baseline(
    lr: DataFrame, cells: DataFrame, targets: Sequence[str] = tuple(TARGETS), lapse: float = 0.0065, run: Sequence[str] = (),
) -> DataFrame:
    """What models are held against: each of ``cells(weatherStation, near, elevation)`` takes the values of its coarse station
    ``near``, the temperature lowered by ``lapse`` degrees for each metre that it lies higher."""
    values = lr.select(F.col("weatherStation").alias("near"), *run, "time", *targets)
    lower = F.col("airTemperature") - F.col("elevation") * F.lit(float(lapse))
    return (
        values.join(cells.select("weatherStation", "near", "elevation"), "near").withColumn("airTemperature", lower)
        .select(*run, "time", "weatherStation", *targets)
    )
