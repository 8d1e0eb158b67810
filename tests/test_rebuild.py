"""Ledgers rebuild what their runs computed; every prefix rebuilds; damage is told."""

import random

from pyspark.sql import functions as F

from loomstate.operators import logs, rebuild
from loomstate.plans import Plan, Run


def arm(v):
    return Plan().effect("read", "quote", v, reads_into="quoted").add("total", v).set("score", v)


def nested():
    inner = lambda v: Plan().add("total", 1).fork(arm(v), arm(2 * v)).select("highest_score").commit().compute("score", 2, F.col("execution_id"))
    return Plan().set("total", 5).fork(inner(5), inner(10), Plan().fail()).select("highest_score").add("late", 1).commit().compute("total", -3, 2).fork(arm(1), arm(2)).select("lowest_score").commit("take_future").add("done", 1)


def executions(spark, n=2):
    return spark.range(1, n + 1).withColumnRenamed("id", "execution_id")


def visible(records, path):
    """What a future holds, record by record."""
    state, forked = {}, {}
    for r in records:
        if r["kind"] == "fork":
            for a in range(r["arms"]):
                forked[(*r["path"], r["arm"] + a)] = r["sequence"]
    for r in records:
        at = tuple(r["path"])
        if path[: len(at)] != at or (len(at) < len(path) and r["sequence"] > forked[path[: len(at) + 1]]):
            continue
        if r["key"] is not None:
            state[r["key"]] = state.get(r["key"], 0) * r["scale"] + r["addend"]
        for c in r["changes"] or ():
            state[c["key"]] = c["value"]
    return {k: v for k, v in state.items()}, forked


def test_rebuilt_equals_run(spark):
    run = Run(nested(), executions(spark))
    records = run.records().cache()
    trunk = rebuild.states(records).where("size(path) = 0").select("execution_id", "key", "value")
    assert logs.agreement(trunk, run.states()).count() == 0
    assert rebuild.commit_mismatches(records).count() == 0 and rebuild.violations(records).count() == 0


def test_every_prefix_rebuilds(spark):
    records = Run(nested(), executions(spark, 1)).records().orderBy("sequence").collect()
    schema = Run(nested(), executions(spark, 1)).records().schema
    # Each prefix is an execution of its own, so that one job takes them all.
    many = [(n, *r[1:]) for n in range(1, len(records) + 1) for r in records[:n]]
    prefixes = spark.createDataFrame(many, schema).cache()
    found = {}
    for r in rebuild.states(prefixes).collect():
        found.setdefault((r["execution_id"], tuple(r["path"])), {})[r["key"]] = r["value"]
    for n in range(1, len(records) + 1):
        own = records[:n]
        for path in [(), *visible(own, ())[1]]:
            assert found.get((n, path), {}) == visible(own, path)[0], (n, path)
    assert rebuild.violations(prefixes).count() == 0 and rebuild.commit_mismatches(prefixes).count() == 0
    assert rebuild.prefix(prefixes, 1).count() == len(records)


def test_damage_is_told(spark):
    records = Run(nested(), executions(spark, 1)).records().cache()
    at = records.where("kind = 'committed' and size(path) = 0").agg(F.min("sequence")).first()[0]
    wrong = records.withColumn("changes", F.when(F.col("sequence") == at, F.expr("transform(changes, c -> named_struct('key', c.key, 'value', c.value + if(c.key = 'score', 1, 0)))")).otherwise(F.col("changes")))
    assert [(r["sequence"], r["key"]) for r in rebuild.commit_mismatches(wrong).collect() if r["sequence"] == at] == [(at, "score")]
    problems = lambda df: {r["problem"] for r in rebuild.violations(df).collect()}
    assert problems(records.where("sequence <> 3")) == {"out of sequence"}
    assert problems(records.where("kind <> 'selected'")) == {"out of sequence", "not selected"}
    assert "before its fork" in problems(records.where("kind <> 'fork'")) and "not opened" in problems(records.where("sequence > 0"))


def test_random_plans(spark):
    rng = random.Random(3)

    def steps(p, n):
        for _ in range(n):
            key, v = rng.choice("abc"), rng.randint(-3, 3)
            rng.choice([lambda: p.add(key, v), lambda: p.set(key, v), lambda: p.compute(key, v, 1), lambda: p.sleep(1), lambda: p.emit("x"), lambda: p.effect("read", "r", v, reads_into=key)])()  # noqa: B023
        return p

    def made(depth):
        p = steps(Plan(), 2)
        if depth:
            p.fork(*(made(depth - 1) for _ in range(2))).select(rng.choice(["highest_score", "lowest_score"]), "a")
            steps(p, 1).commit(rng.choice(["abort", "take_future"]))
        return steps(p, 1)

    for _ in range(4):
        run = Run(made(2), executions(spark, 1))
        records = run.records().cache()
        told = visible(records.orderBy("sequence").collect(), ())[0]
        assert {r["key"]: r["value"] for r in run.states().collect()} == told
        assert {r["key"]: r["value"] for r in rebuild.states(records).where("size(path) = 0").collect()} == told
        assert rebuild.commit_mismatches(records).count() == 0
