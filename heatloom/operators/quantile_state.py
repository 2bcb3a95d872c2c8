"""Quantile statistics that can be merged: what is known of a station's values is counts per bucket of magnitude.

A state has one row for each key, variable and bucket that holds a value: how many there are, the least and the greatest. States of
parts of a table (months, say) add up to that of the whole, in any order, so a new part is taken in without reading the
old ones. A wanted rank is placed between the ends of its bucket, which are less than a factor of 2**(1 / per_doubling) apart: this bounds the
relative error of each quantile. Ranks at a bucket's ends, and all in buckets of one value, are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from ..sources.store import commit, last_entry, ledger, read_store

PER_DOUBLING = 512  # values of a bucket differ by less than 0.14 %
LEAST_EXPONENT = -1100  # below that of the smallest positive double
# A power of two is the first of its bucket, however its logarithm is rounded.
NUDGE = 2.0**-20
STORE_PARTS = 64


def _bucket(v: Column, per_doubling: int) -> Column:
    """Never falls while the value grows."""
    finite = F.least(F.abs(v), F.lit(1.7976931348623157e308))
    size = F.floor((F.log2(finite) - F.lit(float(LEAST_EXPONENT))) * F.lit(float(per_doubling)) + F.lit(NUDGE))
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def quantile_state(
    df: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("weatherStation",), per_doubling: int = PER_DOUBLING,
) -> DataFrame:
    """``(keys…, variable, bucket, n, least, greatest)``; null and NaN are skipped. One aggregate with a map-side part."""
    v = F.col("value")
    clean = df.select(*keys, *[F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in variables])
    long = clean.unpivot(list(keys), list(variables), "variable", "value").where(v.isNotNull())
    return long.groupBy(*keys, "variable", _bucket(v, per_doubling).alias("bucket")).agg(
        F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest")
    )


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all rows of the states given, which must have been made with one ``per_doubling``."""
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    keys = [c for c in whole.columns if c not in ("n", "least", "greatest")]
    return whole.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def stats_of_state(state: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """``(keys…, variable, q05, q95)`` as :func:`quantile_stats` gives them, within the bound of the buckets.

    A group has a row for each of its buckets, whatever the number of values behind them.
    """
    group = [c for c in state.columns if c not in ("bucket", "n", "least", "greatest")]
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    running = state.withColumns({"_c": F.sum("n").over(upto), "_t": F.sum("n").over(whole)})
    before, low, high = F.col("_c") - F.col("n"), F.col("least"), F.col("greatest")

    def ranked(p: float, step: int) -> Column:
        """The value of a wanted rank, in the row of the bucket that holds it."""
        k = F.least(F.floor(F.lit(p) * (F.col("_t") - 1)) + step, F.col("_t") - 1)
        share = F.coalesce(F.try_divide((k - before).cast("double"), (F.col("n") - 1).cast("double")), F.lit(0.0))
        inside = F.when(low == high, low).otherwise(low + (high - low) * share)
        return F.max(F.when((k >= before) & (k < F.col("_c")), inside))

    found = running.groupBy(*group).agg(
        F.max("_t").alias("_t"), *[ranked(p, step).alias(f"_{name}{step}") for name, p in (("lo", lo), ("hi", hi)) for step in (0, 1)]
    )

    def blend(name: str, p: float) -> Column:
        pos = F.lit(p) * (F.col("_t") - 1)
        a, b = F.col(f"_{name}0"), F.col(f"_{name}1")
        return F.when(a == b, a).otherwise(a + (b - a) * (pos - F.floor(pos)))

    return found.select(*group, blend("lo", lo).alias("q05"), blend("hi", hi).alias("q95"))


def add_to_stored_state(
    df: DataFrame, root: str, batch: str, variables: Sequence[str], keys: Sequence[str] = ("weatherStation",),
    per_doubling: int = PER_DOUBLING,
) -> bool:
    """Adds a batch of rows (a month, say) to the state stored at ``root``, once: a batch of that name that was added before changes
    nothing (False). Only the batch and the stored buckets are read. The sum appears whole or not at all. Rows of an added
    batch cannot be taken out again.
    """
    spark = df.sparkSession
    if not ledger(spark, root).where(F.col("batch") == batch).isEmpty():
        return False
    state = materialise(quantile_state(df, variables, keys, per_doubling), "batch-state")
    if last_entry(spark, root)["columns"] is not None:
        held = read_store(spark, root)
        state = merge_states(held.join(state.select(*keys, "variable", "bucket"), [*keys, "variable", "bucket"], "left_semi"), state)
    # Only buckets that the batch met are given to the store, which keeps the others.
    by = F.pmod(F.xxhash64(*keys), F.lit(STORE_PARTS))
    commit(state, root, [*keys, "variable", "bucket"], ["n"], by, batch)
    return True


def stored_stats(spark: SparkSession, root: str, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Statistics of everything that was added at ``root``."""
    return stats_of_state(read_store(spark, root), lo, hi)
