"""Parquet tables: weather, predictions, statistics, rasters, static features."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import year_month
from ..operators.dedup import dedup_keep_first
from ..operators.tables import join_variables, nan_columns_to_null


def month_sequence(first: Column, last: Column) -> Column:
    """Array of year-months ``yyyymm`` between two dates, both ends included."""
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))
    return F.transform(months, lambda d: (F.year(d) * 100 + F.month(d)).cast("int"))


def month_range(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Year-months ``yyyymm`` from first to last inclusive."""
    def start(ym: int) -> Column:
        return F.make_date(F.lit(ym // 100), F.lit(ym % 100), F.lit(1))

    return spark.range(1).select(F.explode(month_sequence(start(first), start(last))).alias("ym"))


def missing_months(months: DataFrame, existing: DataFrame, ym: str = "ym") -> DataFrame:
    """Months that have no stored rows yet."""
    return months.join(existing.select(ym).distinct(), ym, "left_anti")


def read_months(spark: SparkSession, root: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Stored months; the ``ym`` filter prunes partitions."""
    df = spark.read.parquet(root)
    if first is not None:
        df = df.where(F.col("ym") >= first)
    if last is not None:
        df = df.where(F.col("ym") <= last)
    return df


def read_weather(spark: SparkSession, root: str, variables: Sequence[str], years: Sequence[int] | None = None,
                 time: str = "time", key: str = "weatherStation") -> DataFrame:
    """Selected variables of an array-like store; columns and years are pruned
    in the scan."""
    df = spark.read.parquet(root).select(time, key, *variables)
    if years:
        spans = [
            (F.col(time) >= F.lit(f"{y}-01-01").cast("timestamp_ntz"))
            & (F.col(time) < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz"))
            for y in years
        ]
        test = spans[0]
        for s in spans[1:]:
            test = test | s
        df = df.where(test)
    return df


def read_gridded(spark: SparkSession, path_by_var: Mapping[str, str], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """One long table ``(keys…, value)`` per variable, joined to a wide table;
    NaN becomes null."""
    tables = [
        nan_columns_to_null(spark.read.parquet(p)).select(*keys, F.col("value").alias(v)) for v, p in path_by_var.items()
    ]
    return join_variables(tables, keys, how)


def write_predictions(df: DataFrame, root: str, time: str = "time") -> None:
    """One partition per month; only months in ``df`` are replaced. The
    rebalance hint gathers a month's rows and splits a month that is too large
    for one task, so files have an even size."""
    (
        df.withColumn("ym", year_month(F.col(time)))
        .hint("rebalance", F.col("ym"))
        .write.partitionBy("ym").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)
    )


def split_by(df: DataFrame, col: str, root: str) -> None:
    """One folder per value of a column, without a loop over the values."""
    df.write.partitionBy(col).mode("overwrite").parquet(root)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there, complete or not: a write under way is not
    taken for an absent table, and reading it fails instead."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def get_or_build(spark: SparkSession, path: str, builder: Callable[[], DataFrame]) -> DataFrame:
    """The stored table, built and stored first if it is not there."""
    if not exists(spark, path):
        builder().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def static_store_columns(df: DataFrame, unused: Sequence[str]) -> DataFrame:
    """Static features without geometry and unused columns."""
    return df.drop(*unused)


def save_norm_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(path)


def load_norm_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("weatherStation", "variable", "q05", "q95")


def station_coordinates(df: DataFrame) -> DataFrame:
    """Stored coordinates of the fine grid, one row per station."""
    return df.groupBy("weatherStation").agg(F.min("x").alias("x"), F.min("y").alias("y"))


def read_buildings(spark: SparkSession, path: str, order: Sequence[str] = ("x", "y")) -> DataFrame:
    """Building table with one row per reference."""
    return dedup_keep_first(spark.read.parquet(path), ["building_reference"], order)
