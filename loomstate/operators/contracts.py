"""Event contracts: a trigger opens an instance; other events are expected by a deadline, or forbidden beyond a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedupe(events: DataFrame, tenant: str, key: str, order: str) -> DataFrame:
    """The first event of each (tenant, key); events without a key all stay."""
    keyed = events.where(F.col(key).isNotNull())
    first = keyed.groupBy(tenant, key).agg(F.min(order).alias(order))
    return keyed.join(first, [tenant, key, order], "left_semi").unionByName(events.where(F.col(key).isNull()))


def instances(events: DataFrame, trigger: str, correlation: str = "user_id") -> DataFrame:
    """correlation, opened_at, opened_by: the first trigger of each correlation."""
    first = F.min(F.struct("ts", "event_id"))
    return events.where(F.col("event_type") == trigger).groupBy(correlation).agg(first.alias("f")).select(correlation, F.col("f.ts").alias("opened_at"), F.col("f.event_id").alias("opened_by"))


def expectations(opened: DataFrame, events: DataFrame, expected: str, within: str, correlation: str = "user_id") -> DataFrame:
    """opened with due_at and seen_at, the first expected event behind the opening and by the deadline."""
    due = opened.withColumn("due_at", F.col("opened_at") + F.expr(f"interval {within}"))
    seen = events.where(F.col("event_type") == expected).select(correlation, F.col("ts").alias("_ts"))
    found = due.join(seen, correlation, "left").where("_ts is null or (_ts > opened_at and _ts <= due_at)").groupBy(correlation, "opened_by").agg(F.min("_ts").alias("seen_at"))
    return due.join(found, [correlation, "opened_by"], "left").select(*opened.columns, "due_at", "seen_at")


def forbidden(opened: DataFrame, events: DataFrame, event: str, more_than: int, correlation: str = "user_id") -> DataFrame:
    """correlation, hits, violated: how often a forbidden event came behind the opening."""
    hits = events.where(F.col("event_type") == event).select(correlation, F.col("ts").alias("_ts"))
    counted = opened.join(hits, correlation, "left").groupBy(correlation, "opened_by").agg(F.count_if(F.col("_ts") > F.col("opened_at")).alias("hits"))
    return counted.withColumn("violated", F.col("hits") > more_than)


def outcomes(expected: DataFrame, forbids: DataFrame, as_of: Column, correlation: str = "user_id") -> DataFrame:
    """open, satisfied, violated or breached. A violation precedes both others, which exclude each other."""
    both = expected.join(forbids, [correlation, "opened_by"])
    outcome = F.when(F.col("violated"), "violated").when(F.col("seen_at").isNotNull(), "satisfied").when(F.col("due_at") <= as_of, "breached").otherwise("open")
    return both.withColumn("outcome", outcome)


def sweep(expected: DataFrame, as_of: Column, recorded: DataFrame | None = None) -> DataFrame:
    """Breaches due by as_of that are not recorded yet: run again, it gives none twice."""
    due = expected.where(F.col("seen_at").isNull() & (F.col("due_at") <= as_of))
    return due if recorded is None else due.join(recorded, "opened_by", "left_anti")
