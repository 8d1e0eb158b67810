"""Contracts as a table: many contracts and tenants at once, each with several expectations and prohibitions.

contracts: tenant, contract, trigger (an event type; null for one that a breach opens), where (map of text to text, null for none),
expects (array of event, within_ms, critical), forbids (array of event, more_than), deadline_ms (null for none), after_breach_of (a
contract of the same tenant whose breach opens this one, else null). events: tenant, event_id, event_type, ts, correlation, payload (map).

An instance is the first trigger of its tenant, contract and correlation. Every expectation has a deadline of its own, and none beyond
the contract's. An instance is violated once an event has come more often than allowed, else satisfied once all that is expected
was seen in time, else breached at the first deadline that passed; these end it, and the first two are known at the event itself.
Everything follows from the events up to as_of. Contracts are broadcast up to MOST_CONTRACTS; beyond, they are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

KEY = ["tenant", "contract", "correlation"]
MOST_CONTRACTS = 10_000
MILLISECOND = "interval '0.001' second"


def _few(contracts: DataFrame) -> DataFrame:
    return F.broadcast(contracts) if contracts.count() <= MOST_CONTRACTS else contracts


def fulfils(where: Column, payload: Column) -> Column:
    """Whether the payload has all pairs of where; no pairs ask for nothing."""
    has = lambda e: F.coalesce(F.try_element_at(payload, e["key"]) == e["value"], F.lit(False))
    return F.coalesce(F.forall(F.map_entries(where), has), F.lit(True))


def triggered(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """tenant, contract, correlation, opened_at, opened_by of contracts that events open."""
    by = contracts.where("after_breach_of is null").select("tenant", "contract", F.col("trigger").alias("event_type"), "where")
    hits = events.where("correlation is not null").join(_few(by), ["tenant", "event_type"]).where(fulfils(F.col("where"), F.col("payload")))
    return hits.groupBy(*KEY).agg(F.min(F.struct("ts", "event_id")).alias("f")).select(*KEY, F.col("f.ts").alias("opened_at"), F.col("f.event_id").alias("opened_by"))


def escalated(found: DataFrame, contracts: DataFrame) -> DataFrame:
    """The same of contracts that breaches open, at the breach's time; no event opened them."""
    by = contracts.where("after_breach_of is not null").select("tenant", F.col("contract").alias("_next"), F.col("after_breach_of").alias("contract"))
    opened = found.join(_few(by), ["tenant", "contract"]).groupBy("tenant", F.col("_next").alias("contract"), "correlation")
    return opened.agg(F.min("observed_at").alias("opened_at")).select(*KEY, "opened_at", F.lit(None).cast("long").alias("opened_by"))


def _terms(instances: DataFrame, contracts: DataFrame, column: str) -> DataFrame:
    terms = contracts.select("tenant", "contract", "deadline_ms", F.posexplode(column).alias("n", "t")).select("tenant", "contract", "deadline_ms", "n", "t.*")
    return instances.join(_few(terms), ["tenant", "contract"])


def _seen(events: DataFrame) -> DataFrame:
    return events.select("tenant", "correlation", F.col("event_type").alias("event"), F.col("ts").alias("_ts"), F.col("event_id").alias("_id"))


def expectations(instances: DataFrame, events: DataFrame, contracts: DataFrame) -> DataFrame:
    """tenant, contract, correlation, n, event, critical, opened_at, due_at, seen_at of each expectation of each instance."""
    due = _terms(instances, contracts, "expects")
    due = due.withColumn("due_at", F.col("opened_at") + F.least("within_ms", "deadline_ms") * F.expr(MILLISECOND))
    inside = (F.col("_ts") > F.col("opened_at")) & (F.col("_ts") <= F.col("due_at"))
    first = due.join(_seen(events), ["tenant", "correlation", "event"], "left").groupBy(*KEY, "n", "event", "critical", "opened_at", "due_at")
    return first.agg(F.min(F.when(inside, F.col("_ts"))).alias("seen_at"))


def prohibitions(instances: DataFrame, events: DataFrame, contracts: DataFrame) -> DataFrame:
    """tenant, contract, correlation, n, event, hits, violated_at (the time of the first event beyond what is allowed) of each prohibition."""
    told = _terms(instances, contracts, "forbids").join(_seen(events), ["tenant", "correlation", "event"], "left")
    order = Window.partitionBy(*KEY, "n").orderBy("_ts", "_id")
    behind = F.col("_ts") > F.col("opened_at")
    told = told.withColumn("_hit", F.count_if(behind).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    beyond = F.min(F.when(behind & (F.col("_hit") > F.col("more_than")), F.col("_ts")))
    return told.groupBy(*KEY, "n", "event").agg(F.count_if(behind).alias("hits"), beyond.alias("violated_at"))


def outcomes(instances: DataFrame, expected: DataFrame, forbidden: DataFrame, as_of: Column) -> DataFrame:
    """instances with status (open, satisfied, violated, breached) and closed_at. What expects nothing is satisfied as it opens."""
    e = expected.groupBy(*KEY).agg(F.count_if(F.col("seen_at").isNull()).alias("_unseen"), F.max("seen_at").alias("_last"), F.min(F.when(F.col("seen_at").isNull(), F.col("due_at"))).alias("_missed"))
    f = forbidden.groupBy(*KEY).agg(F.min("violated_at").alias("_violated"))
    all_seen = F.coalesce(F.col("_unseen"), F.lit(0)) == 0
    status = F.when(F.col("_violated").isNotNull(), "violated").when(all_seen, "satisfied").when(F.col("_missed") <= as_of, "breached").otherwise("open")
    closed = F.when(F.col("status") == "violated", F.col("_violated")).when(F.col("status") == "satisfied", F.coalesce("_last", "opened_at")).when(F.col("status") == "breached", F.col("_missed"))
    both = instances.join(e, KEY, "left").join(f, KEY, "left").withColumn("status", status).withColumn("closed_at", closed)
    return both.select(*instances.columns, "status", "closed_at")


def breaches(expected: DataFrame, forbidden: DataFrame, as_of: Column) -> DataFrame:
    """tenant, contract, correlation, kind (missing or forbidden), n, event, observed_at: one for each term, however often this is asked."""
    missing = expected.where(F.col("seen_at").isNull() & (F.col("due_at") <= as_of)).select(*KEY, F.lit("missing").alias("kind"), "n", "event", F.col("due_at").alias("observed_at"))
    return missing.unionByName(forbidden.where("violated_at is not null").select(*KEY, F.lit("forbidden").alias("kind"), "n", "event", F.col("violated_at").alias("observed_at")))


def levels(contracts: DataFrame) -> int:
    """How many contracts follow one another at most. Reads the pairs of names, of which contracts have few; a circle is an error."""
    pairs = {(r["tenant"], r["contract"]): r["after_breach_of"] for r in contracts.select("tenant", "contract", "after_breach_of").where("after_breach_of is not null").toLocalIterator()}
    deepest = 0
    for tenant, contract in pairs:
        depth, at = 0, contract
        while (tenant, at) in pairs:
            depth, at = depth + 1, pairs[tenant, at]
            if depth > len(pairs):
                raise ValueError(f"contracts of {tenant} open each other in a circle: {contract}")
        deepest = max(deepest, depth)
    return deepest


def judge(events: DataFrame, contracts: DataFrame, as_of: Column | str) -> tuple[DataFrame, DataFrame]:
    """(outcomes, breaches) of all contracts, those that breaches open too: a stored level for each contract that follows another."""
    as_of = F.lit(as_of) if isinstance(as_of, str) else as_of
    events = events.where(F.col("ts") <= as_of)
    opened, ended, told = triggered(events, contracts), None, None
    for level in range(levels(contracts) + 1):
        if level:
            opened = escalated(found, contracts)  # noqa: F821
        opened = stored(opened, "instances")
        expected, forbidden = expectations(opened, events, contracts), prohibitions(opened, events, contracts)
        found = stored(breaches(expected, forbidden, as_of), "breaches")
        result = outcomes(opened, expected, forbidden, as_of)
        ended, told = (result, found) if ended is None else (ended.unionByName(result), told.unionByName(found))
    return ended, told
