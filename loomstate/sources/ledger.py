"""Ledgers as DataFrames: state operations, effects and futures, read from the tables at hand.

`events` is taken for a ledger of many executions: an execution is a user, its order is the event id. A signup sets
the counter, views and clicks add to it, a purchase computes (scale 2, 3, -1 or 0, then adds), an error sleeps or emits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALES = (2, 3, -1, 0)
KIND_SQL = "CASE event_type WHEN 'signup' THEN 'set' WHEN 'purchase' THEN 'compute' WHEN 'error' THEN CASE event_id % 2 WHEN 0 THEN 'sleep' ELSE 'emit' END ELSE 'add' END"
SCALE_SQL = "CASE WHEN event_type = 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN -1 ELSE 0 END END"
#: The same operations for SQL engines.
OPS_SQL = f"""ops AS (
  SELECT user_id AS execution_id, event_id AS seq, {KIND_SQL} AS kind, 'k' || CAST(event_id % 3 AS VARCHAR) AS key,
         CAST(round(value) AS BIGINT) AS amount, CAST({SCALE_SQL} AS BIGINT) AS scale FROM events)"""
#: And as maps, an emit counting under its own key.
MAPS_SQL = f"""{OPS_SQL}, a AS (
  SELECT execution_id, seq, kind, CASE kind WHEN 'emit' THEN '__emit__' ELSE key END AS key, CAST(CASE kind WHEN 'set' THEN 0 WHEN 'compute' THEN scale ELSE 1 END AS BIGINT) AS scale,
         CASE kind WHEN 'emit' THEN 1 ELSE amount END AS addend FROM ops WHERE kind <> 'sleep')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def operations(spark: SparkSession, sf_dir: str, computes: bool = True) -> DataFrame:
    """execution_id, seq, kind, key, amount, scale. Without computes, purchases add."""
    e = F.col("event_type")
    kind = F.when(e == "signup", "set").when(e == "error", F.when(F.col("event_id") % 2 == 0, "sleep").otherwise("emit"))
    scale = F.element_at(F.array(*map(F.lit, SCALES)), (F.col("event_id") % 4 + 1).cast("int")).cast("long")
    bought = (e == "purchase") & F.lit(computes)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("execution_id"), F.col("event_id").alias("seq"), kind.when(bought, "compute").otherwise("add").alias("kind"),
        F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("key"), F.round("value").cast("long").alias("amount"), F.when(bought, scale).alias("scale"),
    )
