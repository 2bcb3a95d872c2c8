"""Values of the previous and next row of every series, however long.

``lag``/``lead`` over ``partitionBy(station)`` would put a whole station into
one task. Here a series is cut into time buckets: the rows are shuffled by
(series, bucket), and only the first and last row of each bucket travel further
to bridge the cuts. Bridging is done twice, with a coarse bucket the second
time, so the last window sees one row per coarse bucket.

The input is read once for the rows and once for the bucket ends; write out an
input that is itself the result of large joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600
DAY = 24 * HOUR
WEEK = 7 * DAY
# Buckets of the first level that share one bucket of the second level.
BUCKETS_PER_COARSE = 1000


def time_bucket(time: Column, seconds: int) -> Column:
    """Whole number of bucket widths since the epoch; grows with time."""
    return F.floor(F.unix_seconds(time.cast("timestamp")) / F.lit(seconds))


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    cols: Sequence[str] = (),
    tie: Sequence[str] = (),
    bucket_seconds: int = WEEK,
) -> DataFrame:
    """Adds ``_prev_<c>`` and ``_next_<c>`` for the time, the tie columns and
    ``cols``: the values of the row before / after in its series, null at the
    ends. ``_first_<c>`` holds time and tie columns of the first row.

    ``keys`` and ``time`` must not be null. Choose ``bucket_seconds`` so that a
    bucket of the densest series fits a task; it does not change the result.
    """
    keys, order = list(keys), [time, *tie]
    carried = [*order, *[c for c in cols if c not in order]]
    return _over_buckets(df, keys, order, carried, bucket_seconds)


def _shifted(carried: list[str], window) -> dict[str, Column]:
    after = {f"_next_{c}": F.lead(c).over(window) for c in carried}
    return after | {f"_prev_{c}": F.lag(c).over(window) for c in carried}


def _over_buckets(
    df: DataFrame, keys: list[str], order: list[str], carried: list[str], bucket_seconds: int
) -> DataFrame:
    time = order[0]
    base = df.withColumn("_b", time_bucket(F.col(time), bucket_seconds))
    rows = base.withColumns(_shifted(carried, Window.partitionBy(*keys, "_b").orderBy(*order)))

    # With one order column all buffers are plain values and the ends are found
    # by hash aggregation.
    by = F.col(time) if len(order) == 1 else F.struct(*order)
    ends = base.groupBy(*keys, "_b").agg(
        *[F.min_by(c, by).alias(f"f_{c}") for c in carried], *[F.max_by(c, by).alias(f"l_{c}") for c in carried]
    )
    ends = ends.select(
        *keys, "_b", F.floor(F.col("_b") / F.lit(BUCKETS_PER_COARSE)).alias("_c"),
        F.struct(*[F.col(f"f_{c}").alias(c) for c in carried]).alias("_f"),
        F.struct(*[F.col(f"l_{c}").alias(c) for c in carried]).alias("_l"),
    )
    by_coarse = Window.partitionBy(*keys, "_c").orderBy("_b")
    fine = ends.select(
        *keys, "_b", "_c", F.lead("_f").over(by_coarse).alias("_n0"), F.lag("_l").over(by_coarse).alias("_p0")
    )
    by_series = Window.partitionBy(*keys).orderBy("_c")
    coarse = ends.groupBy(*keys, "_c").agg(
        F.min_by("_f", "_b").alias("_f"), F.max_by("_l", "_b").alias("_l")
    ).select(
        *keys, "_c", F.lead("_f").over(by_series).alias("_n1"), F.lag("_l").over(by_series).alias("_p1"),
        F.first("_f").over(by_series).alias("_first"),
    )
    bridge = fine.join(coarse, [*keys, "_c"]).select(
        *keys, "_b", "_first", F.coalesce("_n0", "_n1").alias("_bn"), F.coalesce("_p0", "_p1").alias("_bp")
    )
    joined = rows.join(bridge, [*keys, "_b"])

    def bridged(side: str, edge: str, c: str) -> Column:
        own = F.col(f"_{side}_{c}")
        return F.when(F.col(f"_{side}_{time}").isNotNull(), own).otherwise(F.col(edge)[c]).alias(f"_{side}_{c}")

    return joined.select(
        *df.columns,
        *[bridged("next", "_bn", c) for c in carried],
        *[bridged("prev", "_bp", c) for c in carried],
        *[F.col("_first")[c].alias(f"_first_{c}") for c in order],
    )


def drop_neighbours(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_next_", "_prev_", "_first_"))])


def mark_ends(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str] = (), **cut: int) -> DataFrame:
    """Adds ``is_first`` and ``is_last`` row flags per series."""
    n = with_neighbours(df, keys, time, [], tie, **cut)
    flags = {"is_first": F.col(f"_prev_{time}").isNull(), "is_last": F.col(f"_next_{time}").isNull()}
    return drop_neighbours(n.withColumns(flags))
