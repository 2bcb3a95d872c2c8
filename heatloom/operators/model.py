"""Normalisation, features, splits, training and prediction."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import forecast_hours, fourier, issue_time
from ..functions.keys import station_lat, station_lon
from ..functions.weather import nan_to_null, quantile_scale, quantile_unscale
from ..session import materialise, scratch_path
from .order import quantile_stats, shuffled_rank, time_rank
from .tables import common_times, drop_nulls, paired_product, select_times

# Variables in model order, for forecast and history input.
FORECAST_ORDER = [
    "DHI", "DNI", "GHI", "airTemperature", "relativeHumidity", "sunAzimuth", "sunElevation",
    "totalPrecipitation", "windDirection", "windSpeed",
]
HISTORY_ORDER = [
    "DHI", "DNI", "GHI", "airTemperature", "albedo", "highVegetationRatio", "lowVegetationRatio",
    "relativeHumidity", "soilTemperature", "soilWaterRatio", "sunAzimuth", "sunElevation",
    "totalPrecipitation", "windDirection", "windSpeed",
]
TARGETS = ["airTemperature", "relativeHumidity"]
# Harmonised variables that are no model input.
NOT_USED = ["dewAirTemperature", "windSpeedEast", "windSpeedNorth"]

# Training settings.
TRAINING = {"iterations": 400, "learn_rate": 0.03, "depth": 6, "n_harmonics": 4, "n_hours": 3 * 8760,
            "n_steps": 200, "validation_hours": 1000, "test_ratio": 0.1, "seed": 42, "patience": 30}


def _wide_stats(stats: DataFrame, variables: Sequence[str], key: str) -> DataFrame:
    return stats.groupBy(key).agg(
        *[F.max(F.when(F.col("variable") == v, F.struct("q05", "q95"))).alias(f"_s_{v}") for v in variables]
    )


def normalise(df: DataFrame, stats: DataFrame, variables: Sequence[str], key: str = "weatherStation") -> DataFrame:
    """Values scaled by the stored quantiles of their station, by name."""
    joined = df.join(_wide_stats(stats, variables, key), key, "left")
    return joined.withColumns(
        {v: quantile_scale(F.col(v), F.col(f"_s_{v}.q05"), F.col(f"_s_{v}.q95")) for v in variables}
    ).drop(*[f"_s_{v}" for v in variables])


def denormalise(df: DataFrame, stats: DataFrame, columns: Mapping[str, str], key: str = "weatherStation") -> DataFrame:
    """Scaled columns back to units; ``columns`` maps variable to scaled column."""
    joined = df.join(_wide_stats(stats, list(columns), key), key, "left")
    return joined.withColumns(
        {v: quantile_unscale(F.col(c), F.col(f"_s_{v}.q05"), F.col(f"_s_{v}.q95")) for v, c in columns.items()}
    ).drop(*[f"_s_{v}" for v in columns])


def feature_name(variable: str, station: str) -> str:
    """A column name without dots or signs for one variable at one station."""
    return variable + "__" + re.sub(r"(^|_)(?!m)", r"\1p", station.replace("-", "m").replace(".", "d"))


def wide_by_time(lr: DataFrame, variables: Sequence[str], stations: Sequence[str], time: str = "time",
                 key: str = "weatherStation", run: Sequence[str] = ()) -> DataFrame:
    """One row per time with every variable of every listed station; ``run``
    names columns that tell forecast runs of one time apart."""
    return lr.where(F.col(key).isin(list(stations))).groupBy(*run, time).agg(
        *[
            F.max(F.when(F.col(key) == s, F.col(v))).alias(feature_name(v, s))
            for v in variables for s in stations
        ]
    )


def _with_place_and_time(df: DataFrame, n_harmonics: int, time: str, key: str) -> DataFrame:
    placed = df.withColumns({"latitude": station_lat(F.col(key)), "longitude": station_lon(F.col(key))})
    return fourier(placed, time, n_harmonics)


def build_features(targets: DataFrame, lr: DataFrame, static: DataFrame, variables: Sequence[str],
                   stations: Sequence[str], n_harmonics: int = 4, time: str = "time",
                   key: str = "weatherStation") -> DataFrame:
    """Features of each target row ``(time, station, …)``: low-resolution
    weather of its hour, static features of its cell, coordinates and time
    harmonics. Two equi-joins; the input stays one row per target."""
    joined = targets.join(wide_by_time(lr, variables, stations, time, key), time).join(static, key)
    return _with_place_and_time(joined, n_harmonics, time, key)


def grid_features(lr: DataFrame, static: DataFrame, variables: Sequence[str], stations: Sequence[str],
                  n_harmonics: int = 4, time: str = "time", key: str = "weatherStation", shards: int | None = None,
                  run: Sequence[str] = ()) -> DataFrame:
    """The same features for every hour (of every run) on every cell. The narrow
    cells are copied to all shards and each wide row is shuffled once; the large
    result never is."""
    joined = paired_product(static, wide_by_time(lr, variables, stations, time, key, run), shards)
    return _with_place_and_time(joined, n_harmonics, time, key)


def feature_columns(static: DataFrame, variables: Sequence[str], stations: Sequence[str], n_harmonics: int = 4,
                    key: str = "weatherStation") -> list[str]:
    harmonics = [
        f"{p}_{h}_{f}" for p in ("hour", "month") for h in range(1, n_harmonics + 1) for f in ("sin", "cos")
    ]
    return [
        *[feature_name(v, s) for v in variables for s in stations],
        *[c for c in static.columns if c != key], "latitude", "longitude", *harmonics,
    ]


def split_times(times: DataFrame, ratio: float = 0.1, seed: int = 42, time: str = "time") -> DataFrame:
    """Distinct times with ``is_test``: the first ceil(ratio * n) times of a
    seeded order are the test set."""
    n = times.agg(F.count("*").alias("n")).scalar()
    return shuffled_rank(times, time, seed, "_r").select(
        time, (F.col("_r") <= F.ceil(n * F.lit(ratio))).alias("is_test")
    )


def split_by_time(df: DataFrame, ratio: float = 0.1, seed: int = 42, time: str = "time") -> DataFrame:
    """Adds ``is_test``; whole times are dealt, never single rows."""
    return df.join(split_times(df.select(time).distinct(), ratio, seed, time), time)


def chunk_times(df: DataFrame, n_hours: int, n_steps: int, seed: int = 42, time: str = "time") -> DataFrame:
    """The first ``n_hours`` distinct times in seeded order, cut into chunks."""
    times = time_rank(df.select(time).distinct(), time, "_t").where(F.col("_t") <= n_hours).select(time)
    size = math.ceil(n_hours / n_steps)
    ranked = shuffled_rank(times, time, seed, "_r")
    chunk = F.least(F.floor((F.col("_r") - 1) / F.lit(size)), F.lit(n_steps - 1))
    return ranked.select(time, chunk.cast("bigint").alias("chunk"))


def sample_times(df: DataFrame, n: int, seed: int = 42, time: str = "time") -> DataFrame:
    """``n`` distinct times picked by a seeded order."""
    return shuffled_rank(df.select(time).distinct(), time, seed, "_r").where(F.col("_r") <= n).select(time)


def prepare_training(
    hr: DataFrame, lr: DataFrame, static: DataFrame, variables: Sequence[str], stations: Sequence[str],
    targets: Sequence[str] = tuple(TARGETS), hours: DataFrame | None = None, n_harmonics: int = 4,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training rows, low-resolution statistics, high-resolution statistics).

    Only times that both tables hold count. Statistics come from all of those
    and are computed once; ``hours`` then selects the times that become rows.
    Variables that are no model input are left out.
    """
    variables = [v for v in variables if v not in NOT_USED]
    common = materialise(common_times(hr, lr), "common-times")
    # Written narrow: statistics and features read them three times.
    hr = materialise(select_times(hr.select("time", "weatherStation", *targets), common), "fine-hours")
    lr = materialise(select_times(lr.select("time", "weatherStation", *variables), common), "coarse-hours")
    lr_stats = materialise(quantile_stats(lr, variables), "lr-stats")
    hr_stats = materialise(quantile_stats(hr, targets), "hr-stats")
    if hours is not None:
        hr, lr = select_times(hr, hours), select_times(lr, hours)
    y = normalise(hr, hr_stats, targets)
    y = y.withColumnsRenamed({t: f"y_{t}" for t in targets})
    x = normalise(lr, lr_stats, variables)
    return build_features(y, x, static, variables, stations, n_harmonics), lr_stats, hr_stats


# Stands for a missing feature: below every real value, so trees can split it
# off and no row has to be dropped.
MISSING = -1e6


def fill_missing(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(MISSING)) for c in features})


def best_rounds(errors: Sequence[float], patience: int) -> int:
    """Rounds up to the least error, looking on for ``patience`` rounds without a gain."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_rounds(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model of the first trees of a boosted one."""
    if rounds >= model.getNumTrees:
        return model
    java = model._java_obj
    sc = SparkSession.active().sparkContext
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = sc._gateway.new_array(sc._jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(list(java.trees())[:rounds], model.treeWeights)):
        trees[i], weights[i] = tree, weight
    short = GBTRegressionModel(sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights))
    short._resetUid(java.uid())
    return short.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def train(df: DataFrame, features: Sequence[str], targets: Sequence[str] = tuple(TARGETS),
          params: Mapping | None = None, validation: str | None = None) -> PipelineModel:
    """One boosted-tree regressor per target, label ``y_<t>``, output
    ``pred_<t>``. Rows without a label cannot be trained on and are left out.

    Rows marked by the boolean column ``validation`` are not trained on. The
    model is the one of the round after which ``patience`` rounds bring no
    smaller error on them; without such rows all rounds count. Trees do not
    depend on later ones, so the first of one fit are those of a shorter fit.
    Lineage is cut in the shared scratch folder every ten rounds.
    """
    p = {**TRAINING, **(params or {})}
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "boosting"))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    labels = [f"y_{t}" for t in targets]
    rows = assembler.transform(fill_missing(drop_nulls(df, labels), features))
    rows = rows.select("features", *labels, *([validation] if validation else []))
    held = rows.where(validation) if validation else None
    fit_on = rows.where(~F.col(validation)) if validation else rows
    models = []
    for t in targets:
        gbt = GBTRegressor(
            featuresCol="features", labelCol=f"y_{t}", predictionCol=f"pred_{t}", maxIter=p["iterations"],
            stepSize=p["learn_rate"], maxDepth=p["depth"], seed=p["seed"], checkpointInterval=10,
        )
        fitted = gbt.fit(fit_on)
        if held is not None and not held.isEmpty():
            rounds = best_rounds(fitted.evaluateEachIteration(held, "squared"), p["patience"])
            fitted = first_rounds(fitted, rounds)
        models.append(fitted)
    return PipelineModel(stages=[assembler, *models])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Every input row with ``pred_<t>`` columns."""
    return model.transform(fill_missing(df, model.stages[0].getInputCols())).drop("features")


def assemble_predictions(pred: DataFrame, stats: DataFrame, targets: Sequence[str] = tuple(TARGETS),
                         keep: Sequence[str] = ("time", "weatherStation")) -> DataFrame:
    """Predictions in units, keyed by time and station."""
    units = denormalise(pred.select(*keep, *[f"pred_{t}" for t in targets]), stats, {t: f"pred_{t}" for t in targets})
    return units.select(*keep, *targets)


def forecast_runs(df: DataFrame, today: str, nd: int = 3, time: str = "time") -> DataFrame:
    """Rows of each run issued today and on the ``nd`` days before, stacked,
    with ``forecastingTime``; a run spans its 96 hours."""
    day = F.date_trunc("day", F.lit(today).cast("timestamp_ntz"))
    issues = F.sequence(day - F.expr(f"INTERVAL {nd} DAY"), day, F.expr("INTERVAL 1 DAY"))
    hours = (
        df.sparkSession.range(1).select(F.explode(issues).alias("issue"))
        .select(issue_time(F.col("issue")).cast("timestamp_ntz").alias("forecastingTime"),
                F.explode(forecast_hours(F.col("issue"))).alias("_hour"))
        .withColumn("_hour", F.col("_hour").cast("timestamp_ntz"))
    )
    hour = F.date_trunc("hour", F.col(time)).cast("timestamp_ntz")
    return df.withColumn("_hour", hour).join(hours, "_hour").drop("_hour")


def rmse(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Root mean squared error per target and their mean."""
    per = {t: F.sqrt(F.avg(F.pow(F.col(t) - F.col(p), F.lit(2.0)))) for t, p in pairs.items()}
    out = df.agg(*[e.alias(f"rmse_{t}") for t, e in per.items()])
    mean = sum((F.col(f"rmse_{t}") for t in per), F.lit(0.0)) / len(per)
    return out.withColumn("rmse", mean)
