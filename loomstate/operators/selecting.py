"""Futures: scoring, deterministic selection, what becomes of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .effects import TERMINAL

LOWEST = -(2**63)
#: Evaluators by name, over candidate columns head (the scored key's value), cost_ms, irreversible_deferred. Null refuses.
EVALUATORS: dict[str, Column | None] = {}


def evaluator(name: str) -> Column:
    head = F.col("head")
    return {
        "highest_score": lambda: head,
        "lowest_score": lambda: F.when(head == LOWEST, F.lit(2**63 - 1)).otherwise(-F.greatest(head, F.lit(LOWEST + 1))),
        "cheapest": lambda: -F.col("cost_ms"),
        "first_by_identity": lambda: F.lit(0).cast("long"),
        "only_without_irreversible": lambda: F.when(F.col("irreversible_deferred") == 0, head),
    }[name]()


def select_future(candidates: DataFrame, score: Column | str) -> DataFrame:
    """The winner of each execution (execution_id, future_id, score): highest score, then lowest id; refused and unsettled ones don't stand."""
    score = evaluator(score) if isinstance(score, str) else score
    standing = candidates.where("status = 'evaluable'").withColumn("score", score.cast("long")).where("score is not null")
    best = F.max_by(F.struct("future_id", "score"), F.struct(F.col("score"), -F.col("future_id")))
    return standing.groupBy("execution_id").agg(best.alias("w")).select("execution_id", "w.future_id", "w.score")


def settle(candidates: DataFrame, winners: DataFrame) -> DataFrame:
    """Each candidate's status after the selection: all but the winner are rejected, those that had failed too; before has what each was."""
    won = winners.select("execution_id", F.col("future_id").alias("_won"))
    status = F.when(F.col("_won").isNull(), F.col("status")).when(F.col("future_id") == F.col("_won"), "committed").otherwise("rejected")
    return candidates.join(won, "execution_id", "left").select("execution_id", "future_id", status.alias("status"), F.col("status").alias("before"))


def ready(candidates: DataFrame) -> DataFrame:
    """execution_id, ready: all of its futures have settled."""
    return candidates.groupBy("execution_id").agg(F.bool_and(F.col("status").isin("evaluable", "failed", "rejected", "committed")).alias("ready"))


def next_runnable(futures: DataFrame) -> DataFrame:
    """execution_id, future_id: of the futures (status, ready_at) that can run, the one that is ready first; ties by the lower id."""
    free = futures.where(~F.col("status").isin("blocked", "evaluable", *TERMINAL))
    return free.groupBy("execution_id").agg(F.min(F.struct("ready_at", "future_id")).alias("f")).select("execution_id", "f.future_id")


def nearest_rank(rows: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The value of rank ceil(q * n), not interpolated."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_n")))).select(*by, F.col(value).alias("value"))
