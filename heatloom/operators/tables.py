"""Joins, filters and set steps on whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weather import nan_to_null

def rename_present(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drops rows with a null; unlike ``na.drop`` a NaN is not a null."""
    cols = subset if subset is not None else df.columns
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in cols], F.lit(True)))


def within_bbox(df: DataFrame, lat: str | Column, lon: str | Column, box: Sequence[float]) -> DataFrame:
    """Rows strictly inside ``(lat0, lat1, lon0, lon1)``; the border is out."""
    a = F.col(lat) if isinstance(lat, str) else lat
    b = F.col(lon) if isinstance(lon, str) else lon
    return df.where((a > box[0]) & (a < box[1]) & (b > box[2]) & (b < box[3]))


def isin_keys(df: DataFrame, col: str, keys: DataFrame | Sequence) -> DataFrame:
    """Rows whose key is listed. A Python list becomes a pushed-down filter, a
    table a semi join."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias(col)).distinct(), col, "left_semi")
    return df.where(F.col(col).isin(list(keys)))


def at_time(df: DataFrame, text: str, time: str = "time") -> DataFrame:
    return df.where(F.col(time) == F.lit(text).cast("timestamp_ntz"))


def exceedances(df: DataFrame, limits: Mapping[str, tuple[float, str]], keep: Sequence[str]) -> DataFrame:
    """Long table ``(keep…, variable, value)`` of limit crossings: strictly
    above for condition ``above``, strictly below otherwise."""
    long = df.select(*keep, *limits).unpivot(list(keep), list(limits), "variable", "value")
    v = F.col("value")
    test = F.lit(False)
    for name, (limit, condition) in limits.items():
        crossed = v > limit if condition == "above" else v < limit
        test = test | ((F.col("variable") == name) & crossed)
    return long.where(test)


def replace_with_suffixed(df: DataFrame, suffix: str = "_avg") -> DataFrame:
    """``x_avg`` takes the place of ``x``."""
    new = [c for c in df.columns if c.endswith(suffix)]
    replaced = {c.removesuffix(suffix) for c in new}
    return df.select(
        *[c for c in df.columns if c not in new and c not in replaced],
        *[F.col(c).alias(c.removesuffix(suffix)) for c in new],
    )


def select_suffix(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[c for c in df.columns if c.endswith(suffix)])


def label_keys(df: DataFrame, key: str, labels: DataFrame, alias: str = "locationName") -> DataFrame:
    """Adds the label of each key, or the key itself where there is none.

    ``labels(key, label)`` may hold several labels per key: each gives a row.
    """
    named = labels.select(F.col(key), F.col("label").alias("_label"))
    return df.join(named, key, "left").withColumn(alias, F.coalesce("_label", key)).drop("_label")


def join_variables(tables: Sequence[DataFrame], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Variable tables joined on shared keys. Later copies of a column that is
    already there are left out."""
    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        extra = [c for c in right.columns if c in keys or c not in left.columns]
        return left.join(right.select(*extra), list(keys), how)

    return reduce(add, tables)


def pivot_variables(long: DataFrame, keys: Sequence[str], variables: Sequence[str],
                    variable: str = "variable", value: str = "value", complete: bool = True) -> DataFrame:
    """The same table from long input with one shuffle instead of n - 1 joins.

    ``complete`` keeps only keys that have every variable (inner join).
    """
    wide = long.groupBy(*keys).pivot(variable, list(variables)).agg(F.max(value))
    return drop_nulls(wide, list(variables)) if complete else wide


def attach_coords(df: DataFrame, coords: DataFrame, keys: Sequence[str] = ("x", "y")) -> DataFrame:
    return df.join(coords, list(keys), "left").drop(*keys)


def full_join_coalesced(a: DataFrame, b: DataFrame, keys: Sequence[str], parity: bool = False) -> DataFrame:
    """Full outer join with merged keys. ``parity`` keeps only the left keys,
    so rows found on the right alone have null keys."""
    if not parity:
        return a.join(b, list(keys), "full")
    right = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_r_{k}") for k in keys])
    return a.join(right, match, "full").drop(*[f"_r_{k}" for k in keys])


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def nan_columns_to_null(df: DataFrame) -> DataFrame:
    """NaN in any floating-point column becomes null."""
    return df.withColumns({c: nan_to_null(F.col(c)) for c, t in df.dtypes if t in ("float", "double")})


def append_aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; a column missing on one side is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def common_times(a: DataFrame, b: DataFrame, time: str = "time") -> DataFrame:
    return a.select(time).intersect(b.select(time))


def select_times(df: DataFrame, times: DataFrame, time: str = "time") -> DataFrame:
    return df.join(times.select(time), time, "left_semi")


def incremental_since(new: DataFrame, stored: DataFrame, ts_col: str) -> DataFrame:
    """New rows later than everything stored; all rows when nothing is."""
    mark = stored.agg(F.max(F.col(f"`{ts_col}`")).alias("m")).scalar()
    return new.where(mark.isNull() | (F.col(f"`{ts_col}`") > mark))


def time_bounds(df: DataFrame, time: str = "time") -> DataFrame:
    return df.agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def row_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each value in percent of its row's sum."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    shared = df.withColumn("_sum", total)
    return shared.withColumns({c: F.try_divide(F.col(c) * 100, F.col("_sum")) for c in cols}).drop("_sum")


def check_rectangular(df: DataFrame, time: str = "time", station: str = "weatherStation") -> DataFrame:
    """Counts and whether rows = times x stations."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(time).alias("n_times"),
        F.count_distinct(station).alias("n_stations"),
    ).withColumn("rectangular", F.col("n_rows") == F.col("n_times") * F.col("n_stations"))


def paired_product(a: DataFrame, b: DataFrame, shards: int | None = None) -> DataFrame:
    """Every row of ``a`` with every row of ``b``, for outputs that are a full
    grid by definition (each hour for each cell).

    The rows of ``b`` are dealt over shards and each row of ``a`` visits every
    shard once, so the work is an evenly spread equi-join. Give the smaller
    table as ``a``. Unless told, there are as many shards as shuffle partitions.
    """
    shards = shards or int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = b.withColumn("_shard", F.pmod(F.xxhash64(*b.columns), F.lit(shards)).cast("int"))
    visiting = a.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return visiting.join(dealt, "_shard").drop("_shard")
