"""The end of a stream: a marker row that lets time go on when no data come any more.

Windows and timers of a stream wait for the watermark, and the watermark waits for later rows: what the last rows
of a finished stream belong to would stay in state for ever. A stream built with :func:`closable`
also reads a folder of markers. :func:`close` puts a row there whose only content is a time; the query, run on
from its checkpoint, moves its watermark there and emits what is open. Markers never reach the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that is true in a marker.
MARK = "_marker"
#: Later than any observation; a stream closed so takes no further rows. Far enough from the last timestamp for waiting times to be added.
END_OF_TIME = "5000-01-01"


def marker_schema(stream: DataFrame, time: str = "time"):
    return stream.select(F.col(time).cast("timestamp").alias(time)).schema


def closable(stream: DataFrame, markers: str, time: str = "time") -> DataFrame:
    """The stream with markers from the folder ``markers`` (made if it is not there) mixed in."""
    spark = stream.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(markers)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    rows = stream.withColumns({time: F.col(time).cast("timestamp"), MARK: F.lit(False)})
    ends = spark.readStream.schema(marker_schema(stream, time)).parquet(markers).withColumn(MARK, F.lit(True))
    return rows.unionByName(ends, allowMissingColumns=True)


def close(spark: SparkSession, markers: str, until: str = END_OF_TIME, time: str = "time") -> None:
    """Lets the stream's time reach ``until`` in its next run. Rows more than the lateness before that are late
    from then on, so a stream that goes on is closed up to the end of its last complete day, say. Repeating it does no harm."""
    one = spark.range(1).select(F.lit(until).cast("timestamp").alias(time))
    one.write.mode("append").parquet(markers)


def timed(stream: DataFrame, time: str, lateness: str) -> DataFrame:
    """The stream with its watermark and without markers, which have moved it by then."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    if MARK not in stream.columns:
        return rows
    # A test that compares the time is not moved to before the watermark, so markers are seen there.
    limit = F.when(F.col(MARK), F.lit("0001-01-01")).otherwise(F.lit("9999-12-31")).cast("timestamp")
    return rows.where(F.col(time) < limit).drop(MARK)
