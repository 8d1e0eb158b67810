"""Contracts as a table: terms, tenants, where, precedence, escalation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomstate import catalog
from loomstate.operators import contract_table

T0 = dt.datetime(2026, 1, 1)
MINUTE = 60_000


def events(spark, rows):
    """rows: (tenant, correlation, minute, event_type, payload)."""
    made = [(t, i, e, T0 + dt.timedelta(minutes=m), c, p) for i, (t, c, m, e, p) in enumerate(rows)]
    return spark.createDataFrame(made, "tenant string, event_id long, event_type string, ts timestamp_ntz, correlation string, payload map<string,string>")


ORDER = ("a", "order", "placed", {"channel": "web"}, [("paid", MINUTE, True), ("shipped", 30 * MINUTE, False)], [("paid", 1)], 20 * MINUTE, None)
CHASE = ("a", "chase", None, None, [("called", 5 * MINUTE, True)], [], None, "order")
LAST = ("a", "last", None, None, [("closed", MINUTE, True)], [], None, "chase")
OTHER = ("b", "order", "placed", None, [("paid", 10 * MINUTE, True)], [], None, None)
WEB = {"channel": "web"}


def judge(spark, rows, minute, contracts=(ORDER, CHASE, LAST, OTHER)):
    as_of = F.lit(T0 + dt.timedelta(minutes=minute)).cast("timestamp_ntz")
    ended, told = contract_table.judge(events(spark, rows), catalog.contract_rows(spark, contracts), as_of)
    minutes = lambda x: None if x is None else (x - T0).total_seconds() / 60
    return (
        {(r["tenant"], r["contract"], r["correlation"]): (r["status"], minutes(r["closed_at"])) for r in ended.collect()},
        sorted((r["contract"], r["correlation"], r["kind"], r["event"], minutes(r["observed_at"])) for r in told.collect()),
    )


def test_outcomes(spark):
    rows = [
        ("a", "good", 0, "placed", WEB), ("a", "good", 0.5, "paid", None), ("a", "good", 9, "shipped", None),
        ("a", "late", 0, "placed", WEB), ("a", "late", 2, "paid", None), ("a", "late", 25, "shipped", None),
        ("a", "twice", 0, "placed", WEB), ("a", "twice", 0.5, "paid", None), ("a", "twice", 3, "paid", None), ("a", "twice", 4, "shipped", None),
        ("a", "shop", 0, "placed", {"channel": "shop"}), ("a", "bare", 0, "placed", None), ("a", None, 0, "placed", WEB),
        ("b", "good", 0, "placed", None), ("a", "again", 0, "placed", WEB), ("a", "again", 5, "placed", WEB), ("a", "again", 0, "paid", None),
    ]
    found, told = judge(spark, rows, 60)
    assert found["a", "order", "good"] == ("satisfied", 9) and found["a", "order", "late"] == ("breached", 1)
    assert found["a", "order", "twice"] == ("violated", 3) and found["b", "order", "good"] == ("breached", 10)
    assert found["a", "order", "again"] == ("breached", 1)  # the first trigger counts; an event at the trigger's own time isn't behind it
    assert not {("a", "order", "shop"), ("a", "order", "bare"), ("a", "order", None)} & set(found)
    assert ("order", "late", "missing", "shipped", 20) in told  # no term is due behind the contract's own deadline
    assert ("order", "twice", "forbidden", "paid", 3) in told and ("order", "good", "missing", "paid", 10) in told


def test_as_of(spark):
    rows = [("a", "x", 0, "placed", WEB), ("a", "x", 0.5, "paid", None), ("a", "x", 9, "shipped", None), ("a", "x", 10, "paid", None)]
    assert judge(spark, rows, 5)[0]["a", "order", "x"] == ("open", None)
    assert judge(spark, rows, 9)[0]["a", "order", "x"] == ("satisfied", 9)
    assert judge(spark, rows, 10)[0]["a", "order", "x"] == ("violated", 10)


def test_escalation(spark):
    rows = [("a", "x", 0, "placed", WEB), ("a", "y", 0, "placed", WEB), ("a", "y", 3, "called", None)]
    found, told = judge(spark, rows, 60)
    assert found["a", "chase", "x"] == ("breached", 6) and found["a", "chase", "y"] == ("satisfied", 3) and found["a", "last", "x"] == ("breached", 7)
    assert ("a", "last", "y") not in found and ("last", "x", "missing", "closed", 7) in told
    assert judge(spark, rows, 6.5)[0]["a", "last", "x"] == ("open", None)


def test_circles_and_nothing(spark):
    circle = [("a", "p", None, None, [], [], None, "q"), ("a", "q", None, None, [], [], None, "p")]
    with pytest.raises(ValueError, match="circle"):
        judge(spark, [], 1, circle)
    assert judge(spark, [], 1) == ({}, [])


def test_many_contracts_join_by_a_shuffle(spark, monkeypatch):
    rows = [("a", "x", 0, "placed", WEB), ("a", "y", 0, "placed", WEB), ("a", "y", 3, "called", None), ("b", "x", 1, "placed", None)]
    few = judge(spark, rows, 60)
    monkeypatch.setattr(contract_table, "MOST_CONTRACTS", 0)
    assert judge(spark, rows, 60) == few
