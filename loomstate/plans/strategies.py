"""Named ways to run a plan. They decide what reaches the world and where results come from, never how arms are judged.

deterministic and speculative perform what the plan's dispositions allow; they differ in when records become durable,
which in Spark is the trigger of the job that writes them. observe performs reads and no writes. replay contacts
nothing: it takes results from a journal of the past run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.effects import READ, is_write
from ..operators.logs import agreement
from .plan import Plan, PlanError
from .run import Run

#: What the sink does with a read and with a write that reaches it.
SINKS = {"deterministic": ("read", "performed"), "speculative": ("read", "performed"), "replay": ("suppressed", "suppressed"), "observe": ("read", "suppressed")}


@dataclass(frozen=True)
class Strategy:
    name: str
    #: speculative only: the arms that the plan's widest fork must have, and how many records may wait for durability
    arms: int = 0
    window: int = 0

    def __post_init__(self):
        if self.name not in SINKS:
            raise PlanError(f"no such strategy: {self.name}; there are {', '.join(SINKS)}")

    def check(self, plan: Plan) -> None:
        """Arms are asked for by a strategy that runs them ahead; a plan with another number can't be meant."""
        widest = plan.widest_fork()
        if self.name == "speculative" and widest != self.arms:
            raise PlanError(f"{self.arms} arms were to run ahead, but the widest fork of the plan has {widest}")

    def issued(self, run: Run, journal: DataFrame | None = None) -> DataFrame:
        """The run's effects with sink: what the sink does with each (performed, read, suppressed, waiting), and its result.

        waiting: deferred, and its future wasn't committed. journal (effect_key, result): needed by replay, which fails
        on a read that isn't there rather than making one up.
        """
        self.check(run.plan)
        effects = run.effects()
        goes = (F.col("disposition") == "performed") | F.col("released")
        if self.name == "replay":
            if journal is None:
                raise PlanError("replay needs the journal of a past run")
            past = journal.select("effect_key", F.col("result").alias("_past"))
            known = F.when(F.col("class") == READ, F.coalesce("_past", F.raise_error(F.concat(F.lit("the journal has no "), "effect_key")).cast("long")))
            return effects.join(past, "effect_key", "left").withColumn("result", known).drop("_past").withColumn("sink", F.when(goes, "suppressed").otherwise("waiting"))
        read, write = SINKS[self.name]
        pure = "suppressed" if write == "suppressed" and read == "suppressed" else "performed"
        sink = F.when(F.col("class") == READ, read).when(is_write(F.col("class")), write).otherwise(pure)
        return effects.withColumn("sink", F.when(goes, sink).otherwise("waiting"))


def contract_events(run: Run, issued: DataFrame | None = None) -> DataFrame:
    """execution_id, sequence, event: what happened, in the plan's order and without times, so that strategies compare. With what a
    strategy issued, an effect's event ends in what the sink did."""
    futures = run.futures().select("execution_id", F.lit(1).alias("_at"), "path", F.lit(0).cast("long").alias("_n"), F.concat_ws(" ", F.lit("future"), "path", "status", F.col("score").cast("string")).alias("event"))
    sink = [] if issued is None else ["sink"]
    effects = (run.effects() if issued is None else issued).select("execution_id", F.lit(0).alias("_at"), "path", F.col("ordinal").alias("_n"), F.concat_ws(" ", F.lit("effect"), "effect_key", "class", "disposition", F.col("result").cast("string"), *sink).alias("event"))
    states = run.states().select("execution_id", F.lit(2).alias("_at"), F.col("key").alias("path"), F.lit(0).cast("long").alias("_n"), F.concat(F.lit("state "), "key", F.lit("="), F.col("value").cast("string")).alias("event"))
    together = effects.unionByName(futures).unionByName(states).groupBy("execution_id").agg(F.array_sort(F.collect_list(F.struct("_at", "path", "_n", "event"))).alias("es"))
    return together.select("execution_id", F.posexplode("es").alias("sequence", "e")).select("execution_id", F.col("sequence").cast("long").alias("sequence"), "e.event")


def compare(run: Run, a: Strategy, b: Strategy, journal: DataFrame | None = None) -> DataFrame:
    """execution_id, sequence, event, side: events of two strategies' runs that only one of them has. Empty if they agree."""
    told = lambda s: contract_events(run, s.issued(run, journal) if s.name == "replay" else s.issued(run))
    return agreement(told(a), told(b))


def outbox(issued: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """Writes to send now: performed or released, and not sent under the same key before; run again, none is sent twice."""
    due = issued.where((F.col("sink") == "performed") & is_write(F.col("class")))
    return due if sent is None else due.join(sent.select("effect_key"), "effect_key", "left_anti")
