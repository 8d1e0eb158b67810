"""Plans run end to end, held against literal states."""

import pytest
from pyspark.sql import functions as F

from loomstate.plans import Plan, PlanError, Run


def one(spark, n=1):
    return spark.range(1, n + 1).withColumnRenamed("id", "execution_id")


def state(run, execution=1):
    return {r["key"]: r["value"] for r in run.states().where(F.col("execution_id") == execution).collect()}


def arms(*values, effect=None):
    made = []
    for v in values:
        p = Plan().add("total", v)
        if effect:
            p.effect(effect, "charge", v)
        made.append(p.set("score", v))
    return made


def test_linear(spark):
    plan = Plan()
    for _ in range(5):
        plan.add("counter", 1)
    assert state(Run(plan, one(spark))) == {"counter": 5}
    assert state(Run(Plan().add("x", 1).add("x", 1).compute("x", 10, -4), one(spark))) == {"x": 16}
    with pytest.raises(Exception, match="OVERFLOW"):
        Run(Plan().set("x", F.lit(2**63 - 1)).add("x", 1), one(spark)).states().collect()
    with pytest.raises(Exception, match="OVERFLOW"):
        Run(Plan().set("x", 2**63 - 1).add("x", 1), one(spark)).states().collect()


def test_branching(spark):
    run = Run(Plan().set("total", 0).fork(*arms(10, 20, 15)).select("highest_score").commit().add("committed", 1), one(spark))
    assert state(run) == {"committed": 1, "score": 20, "total": 20}
    assert [r["status"] for r in run.futures().orderBy("path").collect()] == ["rejected", "committed", "rejected"]
    assert state(Run(Plan().set("total", 0).fork(*arms(10, 20)), one(spark))) == {"total": 0}


def test_ties_and_evaluators(spark):
    pick = lambda how, *a: [r["arm"] for r in Run(Plan().fork(*a).select(how), one(spark)).futures().where("status = 'evaluable'").collect()]
    assert pick("highest_score", *arms(7, 7, 3)) == [0]
    assert pick("lowest_score", *arms(500, 5, 50)) == [1]
    assert pick("cheapest", Plan().set("score", 1, cost_ms=9), Plan().set("score", 0, cost_ms=2)) == [1]
    assert pick("first_by_identity", *arms(1, 2)) == [0]
    assert pick("only_without_irreversible", *arms(1), *arms(9, effect="irreversible")) == [0]
    with pytest.raises(PlanError, match="no viable"):
        Run(Plan().fork(*arms(1, 2, effect="irreversible")).select("only_without_irreversible"), one(spark))


def test_failed_arm_and_refusals(spark):
    run = Run(Plan().fork(Plan().set("score", 5), Plan().fail("bad").set("score", 99)).select("highest_score").commit(), one(spark))
    assert state(run) == {"score": 5}
    assert [(r["status"], r["failed"]) for r in run.futures().orderBy("path").collect()] == [("committed", False), ("rejected", True)]
    for bad in (Plan(), Plan().fail(), Plan().select("cheapest"), Plan().fork(*arms(1, 2)).commit()):
        with pytest.raises(PlanError):
            Run(bad, one(spark))
    with pytest.raises(PlanError):
        Plan().fork(Plan())


def test_effects(spark):
    run = Run(Plan().fork(*arms(10, 30, 20, effect="irreversible")).select("highest_score").commit(), one(spark))
    found = run.effects().orderBy("path").collect()
    assert [(r["effect_key"], r["disposition"], r["released"]) for r in found] == [("e1/0.e0", "deferred", False), ("e1/1.e0", "deferred", True), ("e1/2.e0", "deferred", False)]
    seen = Run(Plan().effect("read", "quote", 10, reads_into="quoted").add("counter", 1), one(spark))
    assert state(seen) == {"quoted": 20, "counter": 1} and seen.effects().first()["effect_key"] == "e1/trunk.e0"


def test_nested_forks_merge_into_their_parent(spark):
    inner = lambda v: Plan().fork(*arms(v, 2 * v, effect="irreversible")).select("highest_score").commit().compute("score", 2, 0)
    run = Run(Plan().fork(inner(5), inner(10)).select("highest_score").commit(), one(spark, 2))
    assert state(run, 2) == {"score": 40, "total": 20}
    assert [r["effect_key"] for r in run.effects().where("released and execution_id = 2").collect()] == ["e2/1.1.e0"]


def test_conflicts(spark):
    plan = lambda policy: Plan().set("s", 1).fork(Plan().set("s", 5).set("score", 1), Plan().set("s", 9)).select("highest_score").set("s", 7).add("t", 1).commit(policy)
    kept, taken = Run(plan("abort"), one(spark)), Run(plan("take_future"), one(spark))
    assert state(kept) == {"s": 7, "t": 1} and kept.conflicted().first()["conflicted"]
    assert state(taken) == {"s": 5, "score": 1}
    clean = Run(Plan().set("a", 1).set("b", 1).fork(Plan().set("a", 5), Plan().add("b", 0)).select("first_by_identity").set("b", 9).commit(), one(spark))
    assert state(clean) == {"a": 5, "b": 9} and not clean.conflicted().first()["conflicted"]


def test_states_of_the_executions_come_first(spark):
    states = spark.createDataFrame([(1, "total", 5), (2, "other", 9), (3, "total", 1)], "execution_id long, key string, value long")
    executions = one(spark, 2).withColumn("v", F.col("execution_id") * 10)
    run = Run(Plan().fork(Plan().add("total", F.col("v")).set("score", F.col("v")), Plan().set("score", 15)).select("highest_score").commit(), executions, states)
    assert state(run, 1) == {"total": 5, "score": 15} and state(run, 2) == {"total": 20, "score": 20} and state(run, 3) == {}
    assert state(Run(Plan().add("total", 1), one(spark, 0), states)) == {}


def test_nodes():
    plan = Plan().set("a", 1).fork(Plan().add("a", 1), Plan().add("a", 2).emit("x")).select("cheapest", "a").commit()
    assert plan.nodes() == [(0, (), "set", 1), (1, (), "fork", 5), (2, (0,), "add", -1), (3, (1,), "add", 4), (4, (1,), "emit", -1), (5, (), "select", 6), (6, (), "commit", -1)]
    assert plan.widest_fork() == 2 and plan.keys() == ["__emit__", "a"]
