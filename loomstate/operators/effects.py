"""External effects: keys, dedup, disposition, what is owed, what can be forgotten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import CLASSES

PURE, READ, IDEMPOTENT, COMPENSATABLE, IRREVERSIBLE = CLASSES
TERMINAL = ("committed", "rejected", "abandoned", "failed")


def speculatable(cls: Column) -> Column:
    return cls.isin(PURE, READ, IDEMPOTENT)


def is_write(cls: Column) -> Column:
    return ~cls.isin(PURE, READ)


def speculatable_class(cls: str) -> bool:
    """The same of a plan's own effects, whose classes are known without data."""
    return cls in (PURE, READ, IDEMPOTENT)


def is_write_class(cls: str) -> bool:
    return cls not in (PURE, READ)


def may_perform_now(cls: Column, authoritative: Column) -> Column:
    return authoritative | speculatable(cls)


def effect_key(execution: Column, path: Column, ordinal: Column) -> Column:
    """e1/2.0.e3, or e1/trunk.e4 for an empty path."""
    where = F.when(F.size(path) == 0, F.lit("trunk")).otherwise(F.array_join(path.cast("array<string>"), "."))
    return F.concat(F.lit("e"), execution.cast("string"), F.lit("/"), where, F.lit(".e"), ordinal.cast("string"))


def disposition(effects: DataFrame) -> DataFrame:
    return effects.withColumn("disposition", F.when(may_perform_now(F.col("class"), F.col("authoritative")), "performed").otherwise("deferred"))


def first_results(attempts: DataFrame, bias: int = 1) -> DataFrame:
    """Of attempts (effect_key, seq, class, args) the first per key; reads give 2 * args + bias, others nothing; dedup_hits counts the rest."""
    first = F.min_by(F.struct("class", "args"), F.col("seq"))
    grouped = attempts.groupBy("effect_key").agg(first.alias("f"), F.min("seq").alias("seq"), (F.count("*") - 1).alias("dedup_hits"))
    return grouped.select("effect_key", "seq", F.col("f.class").alias("class"), F.when(F.col("f.class") == READ, F.col("f.args") * 2 + bias).alias("result"), "dedup_hits")


def attempt_log(attempts: DataFrame, bias: int = 1, fails_once: Column | None = None) -> DataFrame:
    """attempts with outcome (failed, performed, repeated) and result. The first attempt of a key that fails_once holds for fails and
    observes nothing; the first that doesn't fail performs, and all behind it have its result."""
    order = Window.partitionBy("effect_key").orderBy("seq")
    fails = (F.row_number().over(order) == 1) & (F.lit(False) if fails_once is None else fails_once)
    told = attempts.withColumn("_fails", fails).withColumn("_n", F.count_if(~F.col("_fails")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    result = F.when(F.col("class") == READ, F.col("args") * 2 + bias)
    first = F.first(F.when(F.col("_n") == 1, result), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    outcome = F.when(F.col("_fails"), "failed").when(F.col("_n") == 1, "performed").otherwise("repeated")
    return told.withColumn("outcome", outcome).withColumn("result", F.when(~F.col("_fails"), first)).drop("_fails", "_n")


def pending_release(effects: DataFrame) -> DataFrame:
    return effects.where((F.col("disposition") == "deferred") & is_write(F.col("class")))


def owed(commits: DataFrame, released: DataFrame) -> DataFrame:
    """What commits list for release and no record says was released."""
    return commits.select("execution_id", F.explode("release").alias("ordinal")).join(released, ["execution_id", "ordinal"], "left_anti")


def reclaimable(effects: DataFrame, futures: DataFrame) -> DataFrame:
    """Effects of terminal futures that aren't deferred."""
    ended = futures.where(F.col("status").isin(*TERMINAL)).select("execution_id", "future_id")
    return effects.where("disposition <> 'deferred'").join(ended, ["execution_id", "future_id"], "left_semi")


def forget(effects: DataFrame, futures: DataFrame) -> DataFrame:
    """effects without those that can be reclaimed."""
    ended = futures.where(F.col("status").isin(*TERMINAL)).select("execution_id", "future_id")
    kept = effects.where("disposition <> 'deferred'").join(ended, ["execution_id", "future_id"], "left_anti")
    return effects.where("disposition = 'deferred'").unionByName(kept)


def journal(attempts: DataFrame, issued: DataFrame | None = None) -> DataFrame:
    """A row for each key, as a keyed log of attempts (effect_key, seq, class, args, deferred) and of what was issued later (effect_key)
    leaves it: a later record of a key replaces it, but an intent (deferred) doesn't replace what is there."""
    rank = F.struct(F.when(F.col("deferred"), -F.col("seq")).otherwise(F.col("seq")).alias("r"))
    latest = F.max_by(F.struct("seq", "class", "args", "deferred"), F.struct((~F.col("deferred")).alias("p"), rank.alias("k")))
    kept = attempts.groupBy("effect_key").agg(latest.alias("e")).select("effect_key", "e.*")
    if issued is None:
        return kept
    sent = issued.select("effect_key", F.lit(True).alias("_sent")).distinct()
    return kept.join(sent, "effect_key", "left").withColumn("deferred", F.col("deferred") & F.col("_sent").isNull()).drop("_sent")


def classes_in_order(effects: DataFrame) -> DataFrame:
    """Each execution's classes, with the place where each is first seen."""
    return effects.groupBy("execution_id", "class").agg(F.min("seq").alias("first_seq"))
