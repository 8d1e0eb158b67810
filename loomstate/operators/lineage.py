"""Lineage of futures, by their stable paths: no recursion is needed where a path names its ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SETTLED = ("evaluable", "committed", "rejected", "abandoned", "failed")


def ancestors(futures: DataFrame) -> DataFrame:
    """execution_id, path, distance, ancestor (a path): nearest first."""
    steps = F.expr("if(size(path) = 0, array(), sequence(1, size(path)))")
    return futures.select("execution_id", "path", F.explode(steps).alias("distance")).withColumn("ancestor", F.expr("slice(path, 1, size(path) - distance)"))


def subtree(futures: DataFrame, path: list[int]) -> DataFrame:
    """A future and all below it."""
    return futures.where(F.slice("path", 1, len(path)) == F.array(*map(F.lit, path)).cast("array<int>")) if path else futures


def remove(futures: DataFrame, gone: DataFrame) -> DataFrame:
    """futures without those of gone (execution_id, path) and all below them: their paths' beginnings are looked up, nothing recurses."""
    heads = futures.select("execution_id", "path", F.explode(F.expr("transform(sequence(0, size(path)), n -> slice(path, 1, n))")).alias("_head"))
    lost = heads.join(gone.select("execution_id", F.col("path").alias("_head")), ["execution_id", "_head"], "left_semi").select("execution_id", "path").distinct()
    return futures.join(lost, ["execution_id", "path"], "left_anti")


def alternatives(futures: DataFrame) -> DataFrame:
    """execution_id, parent, arms, settled: of each future that forked, how many children it has and whether all have settled."""
    below = futures.where(F.size("path") > 0).withColumn("parent", F.expr("slice(path, 1, size(path) - 1)"))
    return below.groupBy("execution_id", "parent").agg(F.count("*").alias("arms"), F.bool_and(F.col("status").isin(*SETTLED)).alias("settled"))


def retain(nodes: DataFrame, futures: DataFrame) -> DataFrame:
    """Of the states kept (execution_id, node) those that a future reaches by base or head."""
    reached = futures.select("execution_id", F.explode(F.array("base", "head")).alias("node")).distinct()
    return nodes.join(reached, ["execution_id", "node"], "left_semi")


def live(futures: DataFrame) -> DataFrame:
    return futures.where(~F.col("status").isin(*SETTLED))


def depth(futures: DataFrame) -> DataFrame:
    """execution_id, depth: the longest path."""
    return futures.groupBy("execution_id").agg(F.max(F.size("path")).alias("depth"))


def orphans(futures: DataFrame) -> DataFrame:
    """Futures whose parent isn't there."""
    parent = futures.where(F.size("path") > 0).withColumn("parent", F.expr("slice(path, 1, size(path) - 1)"))
    return parent.join(futures.select("execution_id", F.col("path").alias("parent")), ["execution_id", "parent"], "left_anti")
