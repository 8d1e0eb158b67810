"""Ledgers as streams: dedup by key within a watermark, running totals, and totals of windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_key(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each key once; a copy later than the watermark allows is taken for new."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def running_totals(events: DataFrame, by: str, value: str = "value") -> DataFrame:
    return events.groupBy(by).agg(F.sum(F.round(value).cast("long")).alias("total"), F.count("*").alias("n"))


def windowed_totals(events: DataFrame, by: str, at: str, width: str, late: str, slide: str | None = None, gap: str | None = None, value: str = "value") -> DataFrame:
    """by, begins, ends, total, n of windows of event time: tumbling, sliding if slide is given, or sessions that end behind a gap.

    A streamed window goes out once the watermark has passed its end; events later than that are dropped. As a batch all windows come.
    """
    own = events.withColumn("_at", F.col(at).cast("timestamp")).where("_at is not null")
    own = own.withWatermark("_at", late) if events.isStreaming else own
    window = F.session_window("_at", gap) if gap else F.window("_at", width, slide or width)
    totals = own.groupBy(by, window.alias("w")).agg(F.sum(F.round(value).cast("long")).alias("total"), F.count("*").alias("n"))
    return totals.select(by, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "total", "n")


def run_to_end(stream: DataFrame, checkpoint: str, mode: str, name: str) -> DataFrame:
    """Runs over all that is there and returns what the sink in memory holds; for tests and small reports."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
