"""As-of lookups: for every row of one table the nearest row in time of another, within its series.

Both tables are cut into time buckets and shuffled once by (series, bucket). A lookup finds its neighbours inside
its bucket; the first and last row of each bucket travel on and bridge buckets that hold none, in two levels,
so a series of any length or weight is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import BUCKETS_PER_COARSE, WEEK, time_bucket

DIRECTIONS = ("nearest", "backward", "forward")


def _reach(values: dict[str, Column], keys: list[str], order: str) -> dict[str, Column]:
    """``_before``: the last known value on or before each row; ``_after``: the first on or after it.

    The second is the first one over descending order: a frame that grows is one pass, one that shrinks is not.
    """
    upto = Window.partitionBy(*keys).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return {
        "_before": F.last(values["_before"], ignorenulls=True).over(upto.orderBy(order)),
        "_after": F.last(values["_after"], ignorenulls=True).over(upto.orderBy(F.col(order).desc())),
    }


def _beyond(keys: list[str], order: str) -> dict[str, Column]:
    """The nearest known value of the buckets strictly before (``_l`` of them) and after (``_f``)."""
    earlier = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return {
        "_p": F.last("_l", ignorenulls=True).over(earlier.orderBy(order)),
        "_n": F.last("_f", ignorenulls=True).over(earlier.orderBy(F.col(order).desc())),
    }


def asof(
    lookups: DataFrame,
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("weatherStation",),
    time: str = "time",
    tie: Sequence[str] = (),
    direction: str = "nearest",
    within: str | None = None,
    prefix: str = "near_",
    bucket_seconds: int = WEEK,
) -> DataFrame:
    """Every row of ``lookups`` with ``<prefix><time>`` and ``<prefix><col>`` of the row of ``df`` it finds in its series.

    ``backward`` finds the last row at or before the lookup's time, ``forward`` the
    first at or after it, ``nearest`` the nearer of both, the earlier if
    they are equally near. Of rows of one series and time the last by ``tie``
    counts. A row further away than the interval ``within`` is not found.
    Lookups that find none, or whose key or time is null, keep null columns.

    Choose ``bucket_seconds`` so that a bucket of the densest series fits a task; it does not change the result.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    keys, cols = list(keys), list(cols)
    own = lookups.columns
    kept = F.struct(F.col(time).alias("_t"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    known = df.where(reduce(and_, [F.col(c).isNotNull() for c in (*keys, time)]))
    rank = F.struct(*tie) if tie else kept
    single = known.groupBy(*keys, time).agg(F.max_by(kept, rank).alias("_d") if tie else F.max(kept).alias("_d"))
    usable = reduce(and_, [F.col(c).isNotNull() for c in (*keys, time)])
    asked = lookups.where(usable).select(*keys, time, F.struct(*own).alias("_row"))
    both = asked.unionByName(single, allowMissingColumns=True).withColumn("_b", time_bucket(F.col(time), bucket_seconds))

    inside = both.withColumns(_reach({"_before": F.col("_d"), "_after": F.col("_d")}, [*keys, "_b"], time)).where("_row IS NOT NULL")
    ends = both.groupBy(*keys, "_b").agg(
        F.min("_d").alias("_f"), F.max("_d").alias("_l"), F.max(F.col("_row").isNotNull()).alias("_asked")
    ).withColumn("_c", F.floor(F.col("_b") / F.lit(BUCKETS_PER_COARSE)))
    fine = ends.withColumns(_beyond([*keys, "_c"], "_b")).where("_asked").select(*keys, "_b", "_c", F.col("_p").alias("_p0"), F.col("_n").alias("_n0"))
    coarse = ends.groupBy(*keys, "_c").agg(F.min("_f").alias("_f"), F.max("_l").alias("_l"))
    coarse = coarse.withColumns(_beyond(keys, "_c")).select(*keys, "_c", F.col("_p").alias("_p1"), F.col("_n").alias("_n1"))
    bridge = fine.join(coarse, [*keys, "_c"]).select(
        *keys, "_b", F.coalesce("_p0", "_p1").alias("_p"), F.coalesce("_n0", "_n1").alias("_n")
    )
    joined = inside.join(bridge, [*keys, "_b"]).select(
        "_row", F.col(time).alias("_t"), F.coalesce("_before", "_p").alias("_before"), F.coalesce("_after", "_n").alias("_after")
    )

    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    back, ahead = micros(F.col("_t")) - micros(F.col("_before._t")), micros(F.col("_after._t")) - micros(F.col("_t"))
    nearer = F.when(F.col("_after").isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    found = {"nearest": nearer, "backward": F.col("_before"), "forward": F.col("_after")}[direction]
    if within is not None:
        limit = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + INTERVAL {within})")
        found = F.when(F.abs(micros(F.col("_t")) - micros(found["_t"])) <= limit, found)
    named = [found["_t"].alias(f"{prefix}{time}"), *[found[f"_v{i}"].alias(f"{prefix}{c}") for i, c in enumerate(cols)]]
    out = joined.select("_row.*", *named)
    missing = lookups.where(reduce(or_, [F.col(c).isNull() for c in (*keys, time)]))
    return out.unionByName(missing, allowMissingColumns=True)
