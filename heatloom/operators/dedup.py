"""Keep-first, keep-last and merge. All are aggregates with a map-side part,
so a key that holds a large share of the rows shrinks before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # The row hash settles equal sequence values, so reruns agree.
    rank = F.struct(*order, F.xxhash64(*df.columns).alias("_h"))
    pick = F.max_by if last else F.min_by
    got = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return got.select(*keys, "_row.*").select(*df.columns)


def dedup_keep_last(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest sequence."""
    return _pick(df, list(keys), list(seq), last=True)


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that comes first in ``order``."""
    return _pick(df, list(keys), list(order), last=False)


def upsert_keep_last(existing: DataFrame, new: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Existing and new rows with one row per key; new rows win over old ones,
    within each side the greater sequence wins."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(
        new.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    return dedup_keep_last(both, keys, ["_side", *seq]).drop("_side")
