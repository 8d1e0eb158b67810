"""Runs that break off anywhere are resumed from their ledgers: same states, every write sent once, what was read stays."""

import pytest
from pyspark.sql import functions as F

from loomstate.operators import logs, rebuild
from loomstate.plans import Plan, Run
from loomstate.plans.strategies import Strategy, outbox


def plan(last=15):
    arm = lambda v, score: Plan().effect("read", "quote", v, reads_into="quoted").effect("irreversible", "charge", v).add("total", v).set("score", score)
    return Plan().set("total", 5).effect("read", "rate", 3, reads_into="rate").fork(arm(1, 10), arm(2, 20), arm(3, last)).select("highest_score").commit().effect("idempotent_write", "tell", 1).add("done", 1)


def executions(spark, n):
    return spark.range(n).withColumnRenamed("id", "execution_id")


@pytest.fixture(scope="module")
def broken(spark):
    """Execution n broke off behind its n-th record: every point of the plan is a point of failure."""
    whole = Run(plan(), executions(spark, 1)).records().count()
    all_of = executions(spark, whole + 1)
    past = rebuild.rollback(Run(plan(), all_of).records(), all_of.withColumn("length", F.col("execution_id"))).cache()
    return whole, all_of, past


def test_resumed_runs_end_alike(spark, broken):
    whole, all_of, past = broken
    run = Run(plan(), all_of, journal=past)
    assert logs.agreement(run.states(), Run(plan(), all_of).states()).count() == 0
    left = rebuild.remaining(run.records(), past)
    counts = {r["execution_id"]: r["count"] for r in left.groupBy("execution_id").count().collect()}
    assert counts == {n: whole - n for n in range(whole)}
    both = past.unionByName(left)
    assert rebuild.strangers(run.records(), both).count() == 0 and rebuild.violations(both.where("execution_id > 0 or sequence >= 0")).count() == 0


def test_what_was_read_stays(spark, broken):
    whole, all_of, past = broken
    now = Run(plan(), all_of, bias=100, journal=past)
    places = {(tuple(r["path"]), r["key"]): r["sequence"] for r in Run(plan(), executions(spark, 1)).records().where("kind = 'effect' and key is not null").collect()}
    for r in now.effects().where("class = 'read'").collect():
        path = tuple(int(x) for x in r["path"].split(".") if x)
        asked = places[path, "quoted" if path else "rate"] >= r["execution_id"]
        assert r["result"] == 2 * r["args"] + (100 if asked else 0)
    assert rebuild.strangers(now.records(), past).count() == 0


def test_writes_are_sent_once(spark, broken):
    """Whatever had been sent before the break, in the order of the ledger, isn't sent again, and all that is due is."""
    whole, all_of, past = broken
    run = Run(plan(), all_of, journal=past)
    due = outbox(Strategy("deterministic").issued(run)).cache()
    assert {(r["execution_id"], r["op_name"]): r["count"] for r in due.groupBy("execution_id", "op_name").count().collect()} == {(n, w): 1 for n in range(whole + 1) for w in ("charge", "tell")}
    sent = due.where((F.col("execution_id") % 3 == 0) & (F.col("op_name") == "charge"))
    again = outbox(Strategy("deterministic").issued(run), sent)
    assert again.join(sent, "effect_key", "left_semi").count() == 0 and again.count() + sent.count() == due.count()


def test_ledgers_of_other_plans_are_told(spark, broken):
    whole, all_of, past = broken
    other = Run(plan(last=99), all_of, journal=past)
    found = {r["execution_id"] for r in rebuild.strangers(other.records(), past).collect()}
    assert found and min(found) > 3


def test_counters(spark):
    arm = lambda v: Plan().effect("irreversible", "charge", v).add("total", v).set("score", v)
    p = Plan().set("total", 1).fork(arm(1), arm(2), Plan().fail()).select("highest_score").add("total", 1).commit().emit("done")
    found = Run(p, executions(spark, 1)).metrics().first().asDict()
    assert found == {
        "execution_id": 0, "steps_executed": 9, "effects_performed": 0, "effects_deferred": 2, "effects_released": 0, "futures_forked": 3, "futures_rejected": 2,
        "futures_failed": 1, "commits": 1, "commits_with_conflicts": 1, "records": 13,
    }
    states = {r["path"]: (r["status"], r["failed"]) for r in Run(p, executions(spark, 1)).futures().collect()}
    assert states["2"] == ("rejected", True) and states["0"] == ("rejected", False)
