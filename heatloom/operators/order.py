"""Ranks and quantiles over whole tables without a one-task sort."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .neighbours import HOUR, time_bucket

HASH_HEX_DIGITS = 3  # 4,096 equally likely buckets


def global_row_number(df: DataFrame, bucket: Column, order: Sequence[str], alias: str) -> DataFrame:
    """Row numbers 1..n in ``order`` over the whole table.

    ``bucket`` must not decrease in that order. Rows are numbered inside their
    bucket; the only one-task step adds up one count per bucket.
    """
    b = df.withColumn("_b", bucket)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy("_b").agg(F.count("*").alias("_n")).select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy("_b").orderBy(*order)
    return (
        b.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, "_b")
        .withColumn(alias, (F.col("_rn") + F.col("_off")).cast("bigint"))
        .drop("_b", "_rn", "_off")
    )


def time_rank(times: DataFrame, time: str, alias: str) -> DataFrame:
    """Position of each distinct time in time order."""
    return global_row_number(times, time_bucket(F.col(time), HOUR), [time], alias)


def seed_hash(time: str, seed: int) -> Column:
    """md5 of the time text and the seed: a shuffle order equal in any engine."""
    return F.md5(F.concat(F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(f"|{seed}")))


def shuffled_rank(times: DataFrame, time: str, seed: int, alias: str) -> DataFrame:
    """Position of each distinct time in a seeded random order."""
    h = times.withColumn("_h", seed_hash(time, seed))
    return global_row_number(h, F.substring("_h", 1, HASH_HEX_DIGITS), ["_h", time], alias).drop("_h")


def _unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(ids), list(cols), "variable", "value"
    )


# Buckets for each doubling of a value: one holds at most 2,048 distinct numbers
# of single precision.
BUCKETS_PER_DOUBLING = 4096
LEAST_EXPONENT = -1100  # below that of the smallest positive double


def _magnitude_bucket(v: Column) -> Column:
    """A whole number that never falls while the value grows: its sign and cut logarithm."""
    size = F.log2(F.least(F.abs(v), F.lit(sys.float_info.max))) - F.lit(float(LEAST_EXPONENT))
    bucket = F.floor(size * F.lit(float(BUCKETS_PER_DOUBLING)))
    return F.when(v == 0, F.lit(0)).when(v > 0, bucket).otherwise(-bucket)


def quantile_stats(
    df: DataFrame,
    variables: Sequence[str],
    lo: float = 0.05,
    hi: float = 0.95,
    keys: Sequence[str] = ("weatherStation",),
) -> DataFrame:
    """Exact linear-interpolated quantiles per key and variable, long form
    ``(keys…, variable, q05, q95)``. Null and NaN are skipped.

    Rows are counted per bucket of magnitude, with a map-side part. The running
    counts tell which buckets hold the wanted ranks, and only the distinct
    values of those (two to four of each group) are sorted. The input is read
    twice; write out one that is itself the result of large joins.
    """
    keys, v = list(keys), F.col("value")
    clean = df.select(*keys, *[F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in variables])
    long = _unpivot(clean, keys, variables).where(v.isNotNull()).withColumn("_bucket", _magnitude_bucket(v))
    group = [*keys, "variable"]
    steps = [(name, p, step) for name, p in (("lo", lo), ("hi", hi)) for step in (0, 1)]

    def has_rank(p: float, step: int) -> Column:
        k = F.least(F.floor(F.lit(p) * (F.col("_t") - 1)) + step, F.col("_t") - 1)
        return (F.col("_c") > k) & (F.col("_c") - F.col("_n") <= k)

    whole = Window.partitionBy(*group)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = long.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    running = counts.withColumns({"_c": F.sum("_n").over(upto), "_t": F.sum("_n").over(whole)})
    wanted = running.where(reduce(or_, [has_rank(p, step) for _, p, step in steps])).select(
        *[F.col(c).alias(f"_w{i}") for i, c in enumerate([*group, "_bucket"])],
        (F.col("_c") - F.col("_n")).alias("_before"), "_t",
    )
    same = [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate([*group, "_bucket"])]
    inside = (
        long.join(wanted, reduce(and_, same))
        .groupBy(*group, "_bucket", "value").agg(F.count("*").alias("_n"), F.first("_before").alias("_before"), F.first("_t").alias("_t"))
    )
    within = Window.partitionBy(*group, "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_c", F.col("_before") + F.sum("_n").over(within))
    found = ranked.groupBy(*group).agg(
        F.max("_t").alias("_t"), *[F.max(F.when(has_rank(p, step), v)).alias(f"_{n}{step}") for n, p, step in steps]
    )

    def blend(n: str, p: float) -> Column:
        pos = F.lit(p) * (F.col("_t") - 1)
        low, high = F.col(f"_{n}0"), F.col(f"_{n}1")
        return F.when(low == high, low).otherwise(low + (high - low) * (pos - F.floor(pos)))

    return found.select(*group, blend("lo", lo).alias("q05"), blend("hi", hi).alias("q95"))


# A value counts as common if it is that of more than one row in this many, so a
# column has fewer than this many common values.
COMMON_SHARE = 1000
SALTS = 4096


def ecdf_rank(df: DataFrame, cols: Sequence[str], ids: Sequence[str], splits: int | None = None) -> DataFrame:
    """``<col>_percentile`` = count(values <= value) / (n - 1) for each column.

    Every row comes back, also where ``ids`` repeat. Constant columns, single rows and null
    values give 0. Equal values are counted before anything is sorted. Distinct values are cut into
    ranges of even size, as many as their amount asks for (``splits`` fixes the number before small ranges are
    joined), and added up within each. Ranks of common values, fewer than
    1,000 a column, are sent to the rows; the others are joined, and no key has more than a thousandth of a column's rows.
    Rows are joined column after column and never grouped, so a task holds no more of them than a join sorts, or spills.
    """
    named, cols = list(ids), list(cols)
    # Numbered once and written, so that a row keeps its number in every scan.
    df = materialise(df.select(*named, *cols).withColumn("_row", F.monotonically_increasing_id()), "ranked-rows")
    counts = _unpivot(df, [], cols).where(F.col("value").isNotNull()).groupBy("variable", "value").agg(F.count("*").alias("_n"))
    # The number of the range is written with the value: it never falls while the values grow.
    cut = counts.repartitionByRange(splits, "variable", "value") if splits else counts.repartitionByRange("variable", "value")
    cut = materialise(cut.withColumn("_b", F.spark_partition_id()), "value-counts")
    inside = Window.partitionBy("variable", "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("variable").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("variable")
    offsets = cut.groupBy("variable", "_b").agg(F.sum("_n").alias("_m"), F.count("*").alias("_k")).select(
        "variable", "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_off"), F.sum("_k").over(whole).alias("_distinct")
    )
    n = df.agg(F.count("*").alias("n")).scalar()
    ranks = cut.withColumn("_c", F.sum("_n").over(inside)).join(offsets, ["variable", "_b"]).select(
        "variable", "value",
        F.when((n <= 1) | (F.col("_distinct") == 1) & (n == F.col("_n")), F.lit(0.0))
        .otherwise((F.col("_c") + F.col("_off")) / F.nullif(n - 1, F.lit(0)))
        .alias("_rank"),
        (F.col("_n") * COMMON_SHARE > n).alias("_common"),
    )
    ranks = materialise(ranks, "value-ranks")
    # Rows that need no join get a salt that no rank has, which spreads them.
    spread = F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int") + 1
    needless = F.col("_known").isNotNull() | F.col("_value").isNull()
    out = df
    for i, c in enumerate(cols):
        own = ranks.where(F.col("variable") == c).withColumnRenamed("value", "_value")
        common = own.where("_common").select("_value", F.col("_rank").alias("_known"))
        rare = own.where("NOT _common").select("_value", F.lit(0).alias("_salt"), "_rank")
        out = out.withColumn("_value", F.col(c).cast("double")).join(F.broadcast(common), "_value", "left")
        out = out.withColumn("_salt", F.when(needless, spread).otherwise(0)).join(rare, ["_value", "_salt"], "left")
        out = out.withColumn(f"_rank{i}", F.coalesce("_known", "_rank", F.lit(0.0))).drop("_value", "_known", "_salt", "_rank")
    return out.select(*named, *[F.col(f"_rank{i}").alias(f"{c}_percentile") for i, c in enumerate(cols)])


def minmax_01(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes 0."""
    bounds = df.agg(
        F.struct(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).alias("b")
    )
    scaled = df.withColumn("_b", bounds.scalar())
    out = {}
    for c in cols:
        lo, hi = F.col("_b")[f"lo_{c}"], F.col("_b")[f"hi_{c}"]
        out[c] = F.when(lo == hi, F.lit(0.0)).otherwise(F.try_divide(F.col(c) - lo, hi - lo))
    return scaled.withColumns(out).drop("_b")
