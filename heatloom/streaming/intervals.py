"""Interval mean across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .endings import timed


def pair_means(v: np.ndarray, circular: np.ndarray) -> np.ndarray:
    """Means of each row and the next one; directions as the batch operator takes them."""
    mean = (v[:-1] + v[1:]) / 2
    if circular.any():
        a, b = np.radians(v[:-1, circular]), np.radians(v[1:, circular])
        mean[:, circular] = np.mod(np.degrees(np.arctan2(np.sin(a) + np.sin(b), np.cos(a) + np.cos(b))), 360.0)
    return mean


def stream_interval_mean(
    stream: DataFrame, variables: Sequence[str], lateness: str, keys: Sequence[str] = ("weatherStation",),
    time: str = "time", idle: str = "3650 days", tie: Sequence[str] = (), batch_col: str | None = None,
    circular: Sequence[str] = (),
) -> DataFrame:
    """Each value becomes the mean of itself and the next one of its series.

    Rows wait in state until the watermark has passed their successor, so late
    rows inside the bound still find their place and the output equals the
    batch operator, also in ``tie`` (whole-number columns that order rows of one
    time), ``batch_col`` (each batch is a series of its own) and ``circular``
    (directions). The newest row of a series has no successor yet: it is
    emitted unaveraged once the watermark is ``idle`` past it, or when the
    stream is closed (see :func:`.endings.close`). State per series: the rows
    inside the lateness bound plus one.
    """
    keys, names, tie = [*keys, *([batch_col] if batch_col else [])], list(variables), list(tie)
    fields = {f.name: f.dataType for f in stream.schema.fields}
    output = T.StructType(
        [T.StructField(k, fields[k]) for k in keys]
        + [T.StructField(time, T.TimestampType())]
        + [T.StructField(c, T.LongType()) for c in tie]
        + [T.StructField(v, T.DoubleType()) for v in names]
    )
    kept = T.StructType(
        [T.StructField("t", T.ArrayType(T.LongType()))]
        + [T.StructField(f"o{i}", T.ArrayType(T.LongType())) for i in range(len(tie))]
        + [T.StructField(f"v{i}", T.ArrayType(T.DoubleType())) for i in range(len(names))]
    )
    idle_us = int(pd.Timedelta(idle).total_seconds()) * 1_000_000
    around = np.array([n in circular for n in names], dtype=bool)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Time and tie columns are rows of ``o``, so one sort orders all.
        o, v = np.empty((1 + len(tie), 0), dtype="int64"), np.empty((0, len(names)))
        if state.exists:
            old = state.get
            o = np.array([list(c) for c in old[: 1 + len(tie)]], dtype="int64").reshape(1 + len(tie), -1)
            v = np.column_stack([np.asarray(c, dtype="float64") for c in old[1 + len(tie) :]])
        if not state.hasTimedOut:
            for frame in frames:
                o = np.concatenate([o, frame[["_us", *tie]].to_numpy("int64").T], axis=1)
                v = np.concatenate([v, frame[names].to_numpy("float64")])
        order = np.lexsort(o[::-1])
        o, v = o[:, order], v[order]
        t = o[0]
        wm_us = state.getCurrentWatermarkMs() * 1000
        # Rows up to the watermark are in final order.
        settled = int(np.searchsorted(t, wm_us, side="right"))
        done = max(0, settled - 1)
        out_o, out_v = o[:, :done], pair_means(v[: done + 1], around) if done else v[:0]
        if len(t) == done + 1 and wm_us - t[-1] >= idle_us:
            out_o, out_v = o, np.concatenate([out_v, v[-1:]])
            done += 1
        o, v = o[:, done:], v[done:]
        t = o[0]
        if len(t):
            state.update((*o.tolist(), *[c.tolist() for c in v.T]))
            wake = t[1] if len(t) > 1 else t[0] + idle_us
            state.setTimeoutTimestamp(max(int(wake // 1000), state.getCurrentWatermarkMs()) + 1)
        else:
            state.remove()
        if out_o.shape[1]:
            frame = pd.DataFrame({k: [x] * out_o.shape[1] for k, x in zip(keys, key)})
            frame[time] = pd.to_datetime(out_o[0], unit="us")
            for i, c in enumerate(tie):
                frame[c] = out_o[1 + i]
            for i, n in enumerate(names):
                frame[n] = out_v[:, i]
            yield frame

    rows = timed(stream, time, lateness).select(
        *keys, time, F.unix_micros(time).alias("_us"), *[F.col(c).cast("bigint").alias(c) for c in tie], *[F.col(n).cast("double").alias(n) for n in names]
    )
    return rows.groupBy(*keys).applyInPandasWithState(
        step, output, kept, "append", GroupStateTimeout.EventTimeTimeout
    )
