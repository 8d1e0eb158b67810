"""Logs: durable prefixes, damage, gaps, chains, and their metrics. No operator collects a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_prefix(frames: DataFrame) -> DataFrame:
    """The frames of each log before its first bad one. frames: execution_id, seq, valid."""
    bad = frames.where("not valid").groupBy("execution_id").agg(F.min("seq").alias("_bad"))
    return frames.join(bad, "execution_id", "left").where("_bad is null or seq < _bad").drop("_bad")


def torn(frames: DataFrame) -> DataFrame:
    """execution_id, kept, dropped, torn_bytes."""
    bad = frames.where("not valid").groupBy("execution_id").agg(F.min("seq").alias("_bad"))
    lost = F.col("_bad").isNotNull() & (F.col("seq") >= F.col("_bad"))
    return frames.join(bad, "execution_id", "left").groupBy("execution_id").agg(
        F.count_if(~lost).alias("kept"), F.count_if(lost).alias("dropped"), F.coalesce(F.sum(F.when(lost, F.col("size"))), F.lit(0)).alias("torn_bytes"))


def offsets(frames: DataFrame) -> DataFrame:
    """frames with offset and end_pos, the bytes of the log before and behind each."""
    order = Window.partitionBy("execution_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("end_pos", F.sum("size").over(order)).withColumn("offset", F.col("end_pos") - F.col("size"))


def commit_prefix(frames: DataFrame, frontier) -> DataFrame:
    """Frames (with end_pos) that a durable frontier includes."""
    return frames.where(F.col("end_pos") <= frontier)


def read_from(frames: DataFrame, position) -> DataFrame:
    """Frames at or behind a position."""
    return frames.where(F.col("offset") >= position)


def truncate_to(frames: DataFrame, position) -> DataFrame:
    return frames.where(F.col("offset") < position)


def boundary(frames: DataFrame, position) -> DataFrame:
    """execution_id, at_boundary: whether the position is where a frame begins, or the end."""
    return frames.groupBy("execution_id").agg(F.bool_or((F.col("offset") == position) | (F.col("end_pos") == position)).alias("at_boundary"))


def freeze_at_gaps(steps: DataFrame, by: list[str]) -> DataFrame:
    """Steps before the first whose parent isn't the version before it; a first step may have any parent of its own base."""
    order = Window.partitionBy(*by).orderBy("seq")
    gap = F.col("parent") != F.lag("version", 1, 0).over(order)
    seen = F.sum(gap.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("_gaps", F.coalesce(seen, F.lit(0))).where("_gaps = 0").drop("_gaps")


def chain_breaks(steps: DataFrame, by: list[str]) -> DataFrame:
    """Steps whose version isn't above the one before it; gaps are allowed."""
    before = F.lag("version").over(Window.partitionBy(*by).orderBy("seq"))
    return steps.withColumn("before", before).where("version <= before").select(*by, "seq", "before", "version")


def metrics(records: DataFrame, by: list[str]) -> DataFrame:
    """Counts of records by kind, in one aggregation."""
    kinds = ("set", "add", "compute", "sleep", "emit", "fail")
    return records.groupBy(*by).agg(F.count("*").alias("records"), *(F.count_if(F.col("kind") == k).alias(f"{k}_records") for k in kinds), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def cost_ms(records: DataFrame, by: list[str]) -> DataFrame:
    """by, cost_ms: the last record's time (at_us) in milliseconds, or the number of steps if that is 0. It isn't a sum."""
    told = records.groupBy(*by).agg(F.max_by("at_us", "sequence").alias("_us"), F.count_if(F.col("kind").isin("step", "effect")).alias("_steps"))
    last = F.expr("_us div 1000")
    return told.select(*by, F.when(last > 0, last).otherwise(F.col("_steps")).cast("long").alias("cost_ms"))


def write_cost_us(size: Column, per_record_us: int = 50, per_kib_us: int = 20, flush_us: int = 10_000) -> Column:
    """Microseconds to write so many bytes at once and flush them, by a model of costs."""
    return (F.lit(per_record_us) + F.lit(per_kib_us) * F.ceil(size / 1024) + F.lit(flush_us)).cast("long")


def group_commit(records: DataFrame, by: list[str], window: int, **costs: int) -> DataFrame:
    """by, flushes, durable_bytes, wait_us, most_waiting: what it costs to make records (sequence, size) durable in groups of `window`, the
    writer waiting for each group; window 1 is the synchronous way."""
    order = Window.partitionBy(*by).orderBy("sequence")
    groups = records.withColumn("_g", F.floor((F.row_number().over(order) - 1) / window)).groupBy(*by, "_g").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n"))
    return groups.groupBy(*by).agg(F.count("*").alias("flushes"), F.sum("_bytes").alias("durable_bytes"), F.sum(write_cost_us(F.col("_bytes"), **costs)).alias("wait_us"), F.max("_n").alias("most_waiting"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; empty just when both agree as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b")))
