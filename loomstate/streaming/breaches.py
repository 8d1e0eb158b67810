"""Breaches of contracts found while events stream in: event-time timers, one for each open instance.

A trigger opens an instance (the first of each correlation); the expected event by the deadline satisfies it; a deadline
passed by the watermark, or by a later event of the same correlation, breaches it. Input is handled before expired timers
in a micro-batch, so each event is compared with the deadline before it is applied, lest a late one should cancel a breach.

Every instance ends as one row, satisfied or breached, and no other may open for its correlation. Those whose deadline
the watermark hasn't passed when a stream ends stay open, and give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: transformWithState needs this store of state.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
COLUMNS = ["correlation", "opened_at", "due_at", "outcome"]
SCHEMA = "correlation long, opened_at timestamp, due_at timestamp, outcome string"


class Instances(StatefulProcessor):
    """State of a correlation: when its instance opened and is due, in microseconds, and whether it has ended."""

    def __init__(self, trigger: str, expected: str, within_seconds: int):
        self.trigger, self.expected, self.within = trigger, expected, within_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.instance = handle.getValueState("instance", "opened long, due long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))[["at_us", "event_id", "event_type"]].sort_values(["at_us", "event_id"])
        held = self.instance.get() if self.instance.exists() else None
        opened, due, ended = held if held else (None, None, False)
        before, out = (opened, due, ended), None
        for at, _, kind in events.itertuples(index=False):
            if ended:
                break
            if opened is None:
                if kind == self.trigger:
                    opened, due = int(at), int(at) + self.within
            elif at > due:
                out, ended = "breached", True
            elif kind == self.expected and at > opened:
                out, ended = "satisfied", True
        if (opened, due, ended) != before:
            self.instance.update((opened, due, ended))
            if before[0] is None and not ended:
                self.handle.registerTimer(self._millis(due))
            elif before[0] is not None and ended:
                self.handle.deleteTimer(self._millis(due))
        yield from self._row(key, opened, due, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened, due, ended = self.instance.get()
        if not ended:
            self.instance.update((opened, due, True))
        yield from self._row(key, opened, due, None if ended else "breached")

    @staticmethod
    def _millis(us: int) -> int:
        """The first millisecond not before the deadline."""
        return -(-us // 1000)

    @staticmethod
    def _row(key, opened, due, outcome) -> Iterator[pd.DataFrame]:
        if outcome:
            yield pd.DataFrame([(key[0], pd.Timestamp(opened, unit="us"), pd.Timestamp(due, unit="us"), outcome)], columns=COLUMNS)

    def close(self) -> None:
        pass


def settle_stream(events: DataFrame, trigger: str, expected: str, within_seconds: int, late: str, correlation: str = "user_id") -> DataFrame:
    """correlation, opened_at, due_at, outcome of each instance as it ends. events: correlation, event_id, event_type, ts.

    Events later than the watermark allows are dropped by it; rows without a correlation or time open nothing. The
    session's provider of state stores is set to the one that timers need.
    """
    events.sparkSession.conf.set(PROVIDER_KEY, PROVIDER)
    at = F.col("ts").cast("timestamp")
    timed = events.where(F.col(correlation).isNotNull() & F.col("ts").isNotNull()).select(F.col(correlation).cast("long").alias("correlation"), "event_id", "event_type", at.alias("at")).withWatermark("at", late)
    own = timed.where(F.col("event_type").isin(trigger, expected)).withColumn("at_us", F.unix_micros("at"))
    return own.groupBy("correlation").transformWithStateInPandas(statefulProcessor=Instances(trigger, expected, within_seconds), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


def sent_once(stream: DataFrame, key: str, path: str, checkpoint: str):
    """Writes each micro-batch's rows whose key isn't at path yet: a batch that is run again after a loss adds none twice."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # A query's id stays with its checkpoint, so another query's batch of the same number is another folder.
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        fresh = batch.dropDuplicates([key])
        try:
            held = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            # The batch's own folder may be left from a run that was lost halfway: it is written anew, and doesn't count as sent.
            other = (F.col("query") != query) | (F.col("batch") != number)
            fresh = fresh.join(held.where(other).select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/query={query}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
