"""Transcript files as a stream of timeline events, and counts of events by time window with late data bounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions import times
from tidelog.sources import transcripts


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``source_id, text`` of each new transcript file."""
    lines = spark.readStream.format("text").option("wholetext", True).load(folder)
    return lines.select(F.sha2("value", 256).alias("source_id"), F.col("value").alias("text"))


def sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Events of each batch handed to write once per batch id; a batch that is tried again has the same events."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: write(transcripts.events(batch), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by source and window of event time; later than the watermark is dropped when streaming."""
    timed = events.withColumn("t", times.parse(F.col("ts"))).filter("t is not null").withWatermark("t", late)
    return timed.groupBy("source_id", F.window("t", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("source_id", F.col("w.start").alias("window_start"), "n")
