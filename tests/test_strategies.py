"""Strategies agree on what happened, and differ only in what reaches the world."""

import pytest
from pyspark.sql import functions as F

from loomstate.operators import logs
from loomstate.plans import Plan, PlanError, Run
from loomstate.plans.strategies import Strategy, compare, contract_events, outbox


def delivery():
    order = F.col("execution_id")
    arm = lambda by, score: Plan().effect("read", "quote", by, reads_into="quoted").effect("irreversible", "charge", by).set("score", score)
    return Plan().set("order", order).fork(arm(1, 10), arm(2, 20), arm(3, 15)).select("highest_score").commit().add("fulfilled", 1)


def test_strategies(spark):
    executions = spark.range(1, 4).withColumnRenamed("id", "execution_id")
    run = Run(delivery(), executions)
    sinks = lambda s, *a: {(r["sink"], r["class"]): r["n"] for r in s.issued(run, *a).groupBy("sink", "class").agg(F.count("*").alias("n")).collect()}
    assert sinks(Strategy("deterministic")) == sinks(Strategy("speculative", 3, 64)) == {("read", "read"): 9, ("performed", "irreversible"): 3, ("waiting", "irreversible"): 6}
    assert sinks(Strategy("observe")) == {("read", "read"): 9, ("suppressed", "irreversible"): 3, ("waiting", "irreversible"): 6}
    journal = Strategy("deterministic").issued(run).select("effect_key", "result")
    assert sinks(Strategy("replay"), journal) == {("suppressed", "read"): 9, ("suppressed", "irreversible"): 3, ("waiting", "irreversible"): 6}
    told = lambda s, *a: s.issued(run, *a).select("effect_key", "result")
    assert logs.agreement(told(Strategy("observe")), told(Strategy("replay"), journal)).count() == 0
    with pytest.raises(Exception, match="the journal has no"):
        Strategy("replay").issued(run, journal.where("effect_key <> 'e1/0.e0'")).collect()
    for bad in (lambda: Strategy("other"), lambda: Strategy("speculative", 4).check(delivery()), lambda: Strategy("replay").issued(run)):
        with pytest.raises(PlanError):
            bad()


def test_outbox_sends_once(spark):
    run = Run(delivery(), spark.range(1, 4).withColumnRenamed("id", "execution_id"))
    due = outbox(Strategy("deterministic").issued(run))
    assert sorted(r["effect_key"] for r in due.collect()) == ["e1/1.e1", "e2/1.e1", "e3/1.e1"]
    assert outbox(Strategy("deterministic").issued(run), due).count() == 0
    assert outbox(Strategy("observe").issued(run)).count() == 0


def test_events_are_in_order(spark):
    run = Run(delivery(), spark.range(7, 8).withColumnRenamed("id", "execution_id"))
    found = [r["event"] for r in contract_events(run).orderBy("sequence").collect()]
    assert found[:2] == ["effect e7/0.e0 read performed 2", "effect e7/0.e1 irreversible deferred"] and found[6:9] == ["future 0 rejected 10", "future 1 committed 20", "future 2 rejected 15"]
    assert found[9:] == ["state fulfilled=1", "state order=7", "state quoted=4", "state score=20"]


def test_comparison(spark):
    """Arms that run ahead change nothing; a world that is only watched gets no write; a past run needs no world."""
    run = Run(delivery(), spark.range(1, 4).withColumnRenamed("id", "execution_id"))
    own = Strategy("deterministic")
    assert compare(run, own, Strategy("speculative", 3)).count() == 0
    told = sorted((r["event"].split()[1], r["event"].split()[-1], r["side"]) for r in compare(run, own, Strategy("observe")).collect())
    assert told == sorted((f"e{i}/1.e1", sink, side) for i in (1, 2, 3) for sink, side in (("performed", "a"), ("suppressed", "b")))
    journal = own.issued(run).select("effect_key", "result")
    assert compare(run, Strategy("observe"), Strategy("replay"), journal).where("event not like '%read%'").count() == 0
