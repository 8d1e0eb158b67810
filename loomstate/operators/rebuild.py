"""Rebuilding executions from their ledgers alone: the state of every future, and whether what was committed follows.

records: execution_id, sequence, path, kind, key, scale, addend, arms, arm, policy, changes, as plans.Run.records gives them,
or any prefix of them. What a future sees is its own steps and, of each ancestor, the steps before the fork that leads
to it. Forks and commits cut a future's records into segments. A segment folds to one affine map for each key, once,
however many futures see it; a future's state is a composition of segments. So there is no stage for each depth of
forks, and no step is read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import merging
from .folding import fold_parts, part_maps

ID = "execution_id"


def prefix(records: DataFrame, length: int) -> DataFrame:
    """The first `length` records of each ledger."""
    return records.where(F.col("sequence") < length)


def segmented(records: DataFrame) -> DataFrame:
    """records with segment: how many forks and commits the same future has before. They are dealt by execution, which all that
    follows within a future or a segment keeps to."""
    before = Window.partitionBy(ID, "path").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.when(F.col("kind").isin("fork", "committed"), 1).otherwise(0)
    return records.repartition(ID).withColumn("segment", F.coalesce(F.sum(cut).over(before), F.lit(0)))


def segment_maps(segments: DataFrame) -> DataFrame:
    """execution_id, path, segment, key, part, m, ops: maps of parts of segments. A commit's changes stand at the head of the segment behind it."""
    as_map = lambda segment, key, scale, addend: F.struct(segment.alias("segment"), key.alias("key"), scale.cast("long").alias("scale"), addend.alias("addend"))
    own = F.when(F.col("key").isNotNull(), F.array(as_map(F.col("segment"), F.col("key"), F.col("scale"), F.col("addend"))))
    sets = F.when(F.col("kind") == "committed", F.transform("changes", lambda c: as_map(F.col("segment") + 1, c["key"], F.lit(0), c["value"])))
    maps = segments.select(ID, "path", F.col("sequence").alias("seq"), F.explode(F.coalesce(own, sets)).alias("m")).select(ID, "path", "seq", "m.*")
    return part_maps(maps, [ID, "path", "segment", "key"])


def futures(records: DataFrame) -> DataFrame:
    """execution_id, path, forked_in: the segment of the parent that ends in the fork; null for the trunk. Steps aren't read."""
    segments = segmented(records.where(F.col("kind").isin("opened", "fork", "committed")))
    trunk = segments.where("kind = 'opened'").select(ID, "path", F.lit(None).cast("long").alias("forked_in"))
    arms = segments.where("kind = 'fork'").select(ID, "path", F.explode(F.expr("sequence(cast(arm as int), cast(arm + arms - 1 as int))")).alias("_arm"), F.col("segment").alias("forked_in"))
    return trunk.unionByName(arms.select(ID, F.concat("path", F.array("_arm")).alias("path"), "forked_in"))


def states_at(records: DataFrame, views: DataFrame) -> DataFrame:
    """execution_id, view, key, value. views: execution_id, view (any type), path, upto: the last of the path's own segments seen, null for all."""
    forks = futures(records).where("size(path) > 0").select(ID, F.col("path").alias("_child"), "forked_in")
    parts = views.select(ID, "view", "path", "upto", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("_n"))
    parts = parts.withColumn("_child", F.when(F.col("_n") < F.size("path"), F.expr("slice(path, 1, _n + 1)"))).withColumn("_at", F.expr("slice(path, 1, _n)"))
    seen = parts.join(forks, [ID, "_child"], "left").select(ID, "view", F.col("_at").alias("path"), "_n", F.when(F.col("_child").isNull(), F.col("upto")).otherwise(F.col("forked_in")).alias("_upto"))
    maps = seen.join(segment_maps(segmented(records)), [ID, "path"]).where("_upto is null or segment <= _upto")
    return fold_parts(maps, [ID, "view", "key"], ["_n", "segment", "part"])


def states(records: DataFrame) -> DataFrame:
    """execution_id, path, key, value of every future, the trunk's path being empty."""
    views = futures(records).select(ID, F.col("path").alias("view"), "path", F.lit(None).cast("long").alias("upto"))
    return states_at(records, views).withColumnRenamed("view", "path")


def commit_mismatches(records: DataFrame) -> DataFrame:
    """execution_id, sequence, key, recorded, recomputed of commits whose changes don't follow from the states merged."""
    cuts = segmented(records.where(F.col("kind").isin("fork", "committed")))
    commits = cuts.where("kind = 'committed'").select(ID, "sequence", "path", "segment", "arm", "policy", "changes")
    child = F.concat("path", F.array(F.col("arm").cast("int")))
    forks = futures(records).where("forked_in is not null").select(ID, F.col("path").alias("_child"), "forked_in")
    known = commits.withColumn("_child", child).join(forks, [ID, "_child"])
    side_of = lambda name, path, upto: F.struct(F.lit(name).alias("side"), F.col(path).alias("path"), upto.cast("long").alias("upto"))
    sides = F.array(side_of("base", "path", F.col("forked_in")), side_of("ours", "_child", F.lit(None)), side_of("theirs", "path", F.col("segment")))
    views = known.select(ID, "sequence", F.explode(sides).alias("s")).select(ID, F.struct(F.col("sequence"), F.col("s.side").alias("side")).alias("view"), "s.path", "s.upto")
    found = states_at(records, views).select(F.struct(ID, F.col("view.sequence").alias("sequence")).alias(ID), F.col("view.side").alias("side"), "key", "value")
    side = lambda name: found.where(F.col("side") == name).select(ID, "key", "value")
    merged = merging.merge(side("base"), side("ours"), side("theirs"))
    policies = known.select(F.struct(ID, "sequence").alias(ID), "policy")
    both = merging.commit(merged, "abort").withColumnRenamed("value", "kept").join(merging.commit(merged, "take_future").select(ID, "key", F.col("value").alias("taken")), merging.BY)
    due = both.join(merged.select(*merging.BY, "theirs"), merging.BY).join(policies, ID)
    recomputed = due.withColumn("recomputed", F.when(F.col("policy") == "abort", F.col("kept")).otherwise(F.col("taken"))).select(*merging.BY, "theirs", "recomputed")
    recorded = known.select(F.struct(ID, "sequence").alias(ID), F.explode("changes").alias("c")).select(ID, "c.key", F.col("c.value").alias("recorded"))
    told = recomputed.join(recorded, merging.BY, "full_outer")
    wrong = ~F.coalesce("recorded", "theirs", F.lit(0)).eqNullSafe(F.coalesce("recomputed", F.lit(0)))
    return told.where(wrong).select(f"{ID}.execution_id", f"{ID}.sequence", "key", "recorded", "recomputed")


def rollback(records: DataFrame, durable: DataFrame) -> DataFrame:
    """records that are durable. durable: execution_id, length, the number of records that are; what came behind them, with all
    futures that were forked there, is gone, as are all records of executions that aren't listed."""
    return records.join(durable.select(ID, F.col("length").alias("_length")), ID).where("sequence < _length").drop("_length")


def remaining(whole: DataFrame, records: DataFrame) -> DataFrame:
    """Of a resumed run's records those that its ledger hasn't yet: what is left to do, in the order of sequence."""
    return whole.join(records.select(ID, "sequence"), [ID, "sequence"], "left_anti")


def strangers(whole: DataFrame, records: DataFrame) -> DataFrame:
    """execution_id, sequence of a ledger's records that aren't the run's: the ledger is another plan's, or is damaged."""
    same = [ID, "sequence", "path", "kind", "key", "scale", "addend", "arms", "arm", "policy"]
    known = whole.select(*(F.col(c).alias(f"_{c}") for c in same))
    equal = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same[2:]]
    alike = (F.col(ID) == F.col(f"_{ID}")) & (F.col("sequence") == F.col("_sequence"))
    for e in equal:
        alike = alike & e
    return records.join(known, alike, "left_anti").select(ID, "sequence")


def violations(records: DataFrame) -> DataFrame:
    """execution_id, sequence, problem: what can't be in a ledger that was written in order. Empty for every prefix of a good one."""
    order = Window.partitionBy(ID).orderBy("sequence")
    gaps = records.withColumn("_want", F.row_number().over(order) - 1).where("_want <> sequence").select(ID, "sequence", F.lit("out of sequence").alias("problem"))
    unopened = records.groupBy(ID).agg(F.min_by("kind", "sequence").alias("k"), F.min("sequence").alias("sequence")).where("k <> 'opened'").select(ID, "sequence", F.lit("not opened").alias("problem"))
    forks = records.where("kind = 'fork'").select(ID, F.explode(F.expr("transform(sequence(cast(arm as int), cast(arm + arms - 1 as int)), a -> concat(path, array(a)))")).alias("path"), F.col("sequence").alias("_forked"))
    known = forks.groupBy(ID, "path").agg(F.min("_forked").alias("_forked"))
    orphans = records.where("size(path) > 0").join(known, [ID, "path"], "left").where("_forked is null or _forked > sequence").select(ID, "sequence", F.lit("before its fork").alias("problem"))
    chosen = records.where("kind = 'selected'").select(ID, "path", "arm", F.col("sequence").alias("_chosen"))
    unselected = records.where("kind = 'committed'").join(chosen, [ID, "path", "arm"], "left").groupBy(ID, "sequence").agg(F.min("_chosen").alias("_chosen")).where("_chosen is null or _chosen > sequence").select(ID, "sequence", F.lit("not selected").alias("problem"))
    return gaps.unionByName(unopened).unionByName(orphans).unionByName(unselected)
