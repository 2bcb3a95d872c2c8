"""Observation ingest, late-bounded daily statistics and de-duplication."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.heat import day_and_night, side_aggregates
from ..sources import store
from ..sources.observations import ARRIVAL, KEYS, clean_observations, stream_observation_files
from .endings import timed


def stream_observations(spark: SparkSession, path: str, table: str, checkpoint: str, max_files: int = 1000,
                        archive: str | None = None, whole_files: bool = True) -> StreamingQuery:
    """Cleans landed files and merges each micro-batch into the store ``table``.

    A batch rewrites only the dates it has rows of. Its name is that of the query and the number of the batch, so a replay
    after a failure finds it in the ledger and changes nothing, or finds nothing and merges it.
    """
    name: list[str] = []

    def merge(batch: DataFrame, batch_id: int) -> None:
        if not name:  # kept in the checkpoint; another one is another query, whose batches are new
            name.append(json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        store.commit(batch, table, KEYS, ARRIVAL, F.to_date("datetime"), f"{name[0]}-{batch_id}")

    rows = clean_observations(stream_observation_files(spark, path, max_files, archive, whole_files))
    return (
        rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_observations(spark: SparkSession, table: str, dates: Sequence[str] | None = None) -> DataFrame:
    """One row per station and time, the later arrival. Merged when it was stored: reading opens the current files
    alone, or those of some dates (``yyyy-mm-dd``)."""
    return store.read_store(spark, table, dates)


def stream_daily_stats(stream: DataFrame, lateness: str, value: str = "heatIndex",
                       keys: Sequence[str] = ("weatherStation",), time: str = "time") -> DataFrame:
    """Night and day statistics per date; rows later than ``lateness`` behind
    the newest are left out. A date is emitted once it is complete, or when the
    stream is closed (see :func:`.endings.close`)."""
    sides = day_and_night(timed(stream, time, lateness), value, time, *keys, time)
    daily = sides.groupBy(F.window(time, "1 day").alias("w"), *keys).agg(*side_aggregates())
    return daily.withColumn("date", F.to_date("w.start")).drop("w")


def stream_dedup(stream: DataFrame, keys: Sequence[str], lateness: str, time: str = "time") -> DataFrame:
    """First arrival of each key within the lateness bound."""
    return timed(stream, time, lateness).dropDuplicatesWithinWatermark(list(keys))
