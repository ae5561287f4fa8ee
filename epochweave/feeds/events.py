"""Event time as running streams: sessions and the removal of repeats, with state, a watermark and late rows.

Rows later than the watermark are left out, and state is dropped as it passes, so that state is bounded by what is open within the
delay, not by the stream. A stream is run over what is there and goes on from its checkpoint with what comes later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochweave.places import qualified


def timed(events: DataFrame, late: str | None) -> DataFrame:
    """With a watermark on ts, or as it is (late None: it has one); times without a zone count as the session's."""
    return events if late is None else events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_counts(events: DataFrame, late: str | None = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by window of event time and type; events later than `late` are left out when they come as a stream."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed(events, late).groupBy(window.alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str | None = "10 minutes", gap: str = "30 minutes", *more: Column) -> DataFrame:
    """Each user's sessions: runs of events with no pause longer than the gap; n events, and more aggregates. As a stream, a session is given out when the watermark has passed its end."""
    return timed(events, late).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"), *more)


def without_repeats(events: DataFrame, late: str | None = "10 minutes") -> DataFrame:
    """The first of events with one id within the watermark."""
    return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def take_in(rows: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """A stream run over all that is there, its rows in files below a folder, each once; all rows that the folder then has."""
    spark = rows.sparkSession
    folder = qualified(spark, folder)
    rows.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(folder)
