"""States in long form (execution_id, key, value): differences, three-way merge, commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BY = ["execution_id", "key"]


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """execution_id, key, a, b of keys whose values differ; an absent key reads 0."""
    both = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), BY, "full_outer").fillna(0, ["a", "b"])
    return both.where("a <> b")


def logically_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """execution_id, equal: the same keys are present, with the same values."""
    both = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), BY, "full_outer")
    return both.groupBy("execution_id").agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("equal"))


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """execution_id, key, base, ours, theirs, merged, conflict, over the keys of ours and theirs."""
    sides = ours.withColumnRenamed("value", "ours").join(theirs.withColumnRenamed("value", "theirs"), BY, "full_outer").join(base.withColumnRenamed("value", "base"), BY, "left")
    full = sides.fillna(0, ["base", "ours", "theirs"])
    conflict = (F.col("ours") != F.col("base")) & (F.col("theirs") != F.col("base")) & (F.col("ours") != F.col("theirs"))
    merged = F.when(conflict, F.lit(None)).when(F.col("ours") == F.col("base"), F.col("theirs")).otherwise(F.col("ours"))
    return full.select(*BY, "base", "ours", "theirs", merged.alias("merged"), conflict.alias("conflict"))


def conflicts(merged: DataFrame) -> DataFrame:
    return merged.where("conflict").select(*BY, "base", "ours", "theirs")


def commit(merged: DataFrame, on_conflict: str = "abort") -> DataFrame:
    """The new trunk. abort: an execution with a conflict keeps theirs; take_future: it takes ours entirely."""
    any_conflict = F.bool_or("conflict").over(Window.partitionBy("execution_id"))
    fallback = {"abort": "theirs", "take_future": "ours"}[on_conflict]
    full = merged.withColumn("_any", any_conflict)
    return full.select(*BY, F.when(F.col("_any"), F.col(fallback)).otherwise(F.col("merged")).alias("value"), F.col("_any").alias("conflicted"))


def address(state: DataFrame) -> DataFrame:
    """execution_id, node: a content address that doesn't depend on the order of keys."""
    pair = F.concat_ws("=", "key", F.col("value").cast("string"))
    return state.groupBy("execution_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), ",").cast("binary"), 256).alias("node"))
