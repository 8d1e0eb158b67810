"""Every query of the library's own operators, by name, and its SQL twin.

A query applies one operator to whole tables: `events` as ledgers, contracts and logs, `lineitem` as effects,
`orders` as futures to choose from, `customer` as a tree of futures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codes
from .operators import contract_table, contracts, effects, folding, lineage, logs, merging, rebuild, selecting, store
from .plans import Plan, Run, strategies
from .sources import frames as binary
from .sources import records
from .sources.ledger import MAPS_SQL, OPS_SQL, operations, table
from .storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


KEY = ["execution_id", "key"]
named = lambda c: F.array_join(F.col(c).cast("array<string>"), ".").alias(c)
LIST_SQL = "list({s: CAST(scale AS HUGEINT), c: CAST(addend AS HUGEINT)} ORDER BY seq)"
#: Final states of all keys: maps of every scale, one after the other from 0.
STATES_SQL = f"""WITH {MAPS_SQL}, states AS (
  SELECT execution_id, key, CAST(list_reduce(list_concat([{{s: CAST(0 AS HUGEINT), c: CAST(0 AS HUGEINT)}}], {LIST_SQL}), lambda m, o: {{s: m.s * o.s, c: m.c * o.s + o.c}}).c AS BIGINT) AS value
  FROM a GROUP BY execution_id, key)"""


# Folds


@query("state_fold_affine", STATES_SQL + " SELECT * FROM states")
def state_fold_affine(spark, d):
    return folding.fold_affine(operations(spark, d), KEY)


SUMS_SQL = f"""WITH {OPS_SQL}, b AS (SELECT execution_id, seq, CASE kind WHEN 'compute' THEN 'add' ELSE kind END AS kind, CASE kind WHEN 'emit' THEN '__emit__' ELSE key END AS key, CASE kind WHEN 'emit' THEN 1 ELSE amount END AS amount FROM ops WHERE kind <> 'sleep')"""


@query("state_fold_closed", SUMS_SQL + """, l AS (SELECT execution_id, key, max(seq) AS f FROM b WHERE kind = 'set' GROUP BY ALL)
SELECT execution_id, key, CAST(sum(amount) AS BIGINT) AS value FROM b LEFT JOIN l USING (execution_id, key) WHERE f IS NULL OR seq >= f GROUP BY ALL""")
def state_fold_closed(spark, d):
    return folding.fold_closed(operations(spark, d, computes=False), KEY)


@query("state_prefix_sums", SUMS_SQL + """, g AS (SELECT *, CAST(sum(CASE WHEN kind = 'set' THEN 1 ELSE 0 END) OVER (PARTITION BY execution_id, key ORDER BY seq) AS BIGINT) AS segment FROM b)
SELECT execution_id, key, seq, segment, CAST(sum(amount) OVER (PARTITION BY execution_id, key, segment ORDER BY seq) AS BIGINT) AS value FROM g""")
def state_prefix_sums(spark, d):
    return folding.prefix_sums(operations(spark, d, computes=False), KEY).select(*KEY, "seq", "segment", "value")


@query("state_prefix_versions", f"""WITH {MAPS_SQL}, h AS (SELECT execution_id, key, list({{q: seq, s: CAST(scale AS HUGEINT), v: CAST(addend AS HUGEINT), past: CAST([] AS STRUCT(q BIGINT, v HUGEINT)[])}} ORDER BY seq) AS ms FROM a GROUP BY execution_id, key),
r AS (SELECT execution_id, key, list_reduce(list_concat([{{q: CAST(-1 AS BIGINT), s: CAST(0 AS HUGEINT), v: CAST(0 AS HUGEINT), past: CAST([] AS STRUCT(q BIGINT, v HUGEINT)[])}}], ms),
  lambda m, o: {{q: o.q, s: o.s, v: m.v * o.s + o.v, past: list_append(m.past, {{q: o.q, v: m.v * o.s + o.v}})}}).past AS past FROM h), u AS (SELECT execution_id, key, unnest(past) AS p FROM r)
SELECT execution_id, key, p.q AS seq, CAST(p.v AS BIGINT) AS value FROM u""")
def state_prefix_versions(spark, d):
    return folding.prefix_states(operations(spark, d), KEY).select(*KEY, "seq", "value")


@query("affine_maps", f"WITH {MAPS_SQL} SELECT execution_id, seq, kind, key, scale, addend FROM a")
def affine_maps(spark, d):
    return folding.affine(operations(spark, d)).select("execution_id", "seq", "kind", "key", "scale", "addend")


def _runs_sql(ops: str) -> str:
    return ops + """, m AS (SELECT *, kind IN ('sleep', 'emit') AS barrier, lag(key) OVER w AS k0, lag(kind IN ('sleep', 'emit'), 1, true) OVER w AS b0 FROM ops WINDOW w AS (PARTITION BY execution_id ORDER BY seq)),
r AS (SELECT *, sum(CASE WHEN barrier OR b0 OR k0 <> key THEN 1 ELSE 0 END) OVER (PARTITION BY execution_id ORDER BY seq) AS run FROM m)"""


@query("delta_runs", _runs_sql(f"WITH {OPS_SQL}") + " SELECT execution_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS ops FROM r GROUP BY execution_id, run")
def delta_runs(spark, d):
    return folding.runs(operations(spark, d)).groupBy("execution_id", "run").agg(F.max("seq").alias("last_seq"), F.count("*").alias("ops")).withColumnRenamed("run", "first_seq")


def _coalesce_sql(ops: str) -> str:
    """A run's operations one after the other: done has what has gone out, the rest is the run so far; open tells whether there is one."""
    row = "STRUCT(seq BIGINT, kind VARCHAR, scale HUGEINT, amount HUGEINT, folded BIGINT)[]"
    out = lambda m: f"CASE WHEN {m}.s = 1 AND {m}.c = 0 THEN [] ELSE [{{seq: {m}.seq, kind: {m}.kind, scale: {m}.s, amount: {m}.c, folded: {m}.n}}] END"
    fits = "o.s * m.s BETWEEN -9223372036854775808 AND 9223372036854775807 AND o.s * m.c + o.c BETWEEN -9223372036854775808 AND 9223372036854775807"
    raw = "[{seq: o.seq, kind: o.kind, scale: o.s, amount: o.c, folded: CAST(1 AS BIGINT)}]"
    return _runs_sql(ops) + f""", c AS (SELECT *, CAST(CASE kind WHEN 'set' THEN 0 WHEN 'compute' THEN scale ELSE 1 END AS HUGEINT) AS s FROM r),
g AS (SELECT execution_id, run, any_value(key) AS key, list({{s: s, c: CAST(amount AS HUGEINT), n: CAST(1 AS BIGINT), seq: seq, kind: kind, open: true, done: CAST([] AS {row})}} ORDER BY seq) AS os FROM c WHERE NOT barrier GROUP BY execution_id, run),
f AS (SELECT execution_id, key, list_reduce(os, lambda m, o: CASE WHEN NOT m.open THEN {{s: o.s, c: o.c, n: o.n, seq: o.seq, kind: o.kind, open: true, done: m.done}}
  WHEN {fits} THEN {{s: o.s * m.s, c: o.s * m.c + o.c, n: m.n + 1, seq: o.seq, kind: 'compute', open: true, done: m.done}}
  ELSE {{s: o.s, c: o.c, n: o.n, seq: o.seq, kind: o.kind, open: false, done: CAST(list_concat(list_concat(m.done, {out("m")}), {raw}) AS {row})}} END) AS m FROM g),
u AS (SELECT execution_id, key, unnest(CASE WHEN m.open THEN list_concat(m.done, {out("m")}) ELSE m.done END) AS x FROM f)
SELECT execution_id, x.seq, x.kind, key, CAST(x.scale AS BIGINT) AS scale, CAST(x.amount AS BIGINT) AS amount, x.folded FROM u
UNION ALL SELECT execution_id, seq, kind, key, CAST(1 AS BIGINT), amount, CAST(1 AS BIGINT) FROM r WHERE barrier"""


@query("delta_coalesce", _coalesce_sql(f"WITH {OPS_SQL}"))
def delta_coalesce(spark, d):
    return folding.coalesce_runs(operations(spark, d))


LARGE_SQL = OPS_SQL.replace("ops AS", "small AS") + """, ops AS (SELECT execution_id, seq, kind, 'k' || CAST(seq // 40 % 2 AS VARCHAR) AS key, CASE kind WHEN 'set' THEN amount ELSE amount % 7 * 1000000000000000000 END AS amount, scale FROM small)"""


@query("delta_coalesce_overflow", _coalesce_sql(f"WITH {LARGE_SQL}"))
def delta_coalesce_overflow(spark, d):
    """Long runs of large amounts: many leave 64 bits and are parted there."""
    amount = F.when(F.col("kind") == "set", F.col("amount")).otherwise(F.col("amount") % 7 * 10**18)
    key = F.concat(F.lit("k"), (F.floor(F.col("seq") / 40) % 2).cast("string"))
    return folding.coalesce_runs(operations(spark, d).withColumns({"amount": amount, "key": key}))


# States and merges

SIDES = {"base": (0, 1, 2), "ours": (0, 1, 2, 3, 4), "theirs": (0, 1, 2, 5, 6)}


def sides(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Three states of each execution: common slices of its events, and two that add slices of their own."""
    ops = operations(spark, d)
    return {n: ops.where((F.col("seq") % 7).isin(*s)).groupBy(*KEY).agg((F.sum("amount") % 5).alias("value")) for n, s in SIDES.items()}


SIDES_SQL = f"WITH {OPS_SQL}, " + ", ".join(f"{n} AS (SELECT execution_id, key, CAST(sum(amount) % 5 AS BIGINT) AS value FROM ops WHERE seq % 7 IN {s} GROUP BY ALL)" for n, s in SIDES.items())
MERGE_SQL = SIDES_SQL + """, m AS (
  SELECT execution_id, key, coalesce(b.value, 0) AS base, coalesce(o.value, 0) AS ours, coalesce(t.value, 0) AS theirs
  FROM ours o FULL JOIN theirs t USING (execution_id, key) LEFT JOIN base b USING (execution_id, key)),
c AS (SELECT *, ours <> base AND theirs <> base AND ours <> theirs AS conflict FROM m)"""


def merged(spark, d):
    s = sides(spark, d)
    return merging.merge(s["base"], s["ours"], s["theirs"])


@query("state_diff", SIDES_SQL + " SELECT execution_id, key, coalesce(o.value, 0) AS a, coalesce(t.value, 0) AS b FROM ours o FULL JOIN theirs t USING (execution_id, key) WHERE coalesce(o.value, 0) <> coalesce(t.value, 0)")
def state_diff(spark, d):
    s = sides(spark, d)
    return merging.diff(s["ours"], s["theirs"])


@query("state_logical_eq", SIDES_SQL + " SELECT execution_id, bool_and(o.value IS NOT DISTINCT FROM t.value) AS equal FROM ours o FULL JOIN theirs t USING (execution_id, key) GROUP BY ALL")
def state_logical_eq(spark, d):
    s = sides(spark, d)
    return merging.logically_equal(s["ours"], s["theirs"])


ADDRESS_SQL = "sha256(string_agg(key || '=' || CAST(value AS VARCHAR), ',' ORDER BY key || '=' || CAST(value AS VARCHAR)))"


@query("state_address", STATES_SQL + f" SELECT execution_id, {ADDRESS_SQL} AS node FROM states GROUP BY ALL")
def state_address(spark, d):
    return merging.address(state_fold_affine(spark, d))


@query("state_store_dedup", STATES_SQL + f""", v AS (SELECT execution_id, key, value % 2 AS value FROM states), n AS (SELECT execution_id, {ADDRESS_SQL} AS node FROM v GROUP BY ALL)
SELECT count(DISTINCT node) AS distinct_states, count(*) - count(DISTINCT node) AS deduped FROM n""")
def state_store_dedup(spark, d):
    """Whole states, by the last bit of each value so that some are equal."""
    bits = state_fold_affine(spark, d).withColumn("value", F.col("value") % 2)
    nodes = merging.address(bits)
    return nodes.agg(F.count_distinct("node").alias("distinct_states"), (F.count("*") - F.count_distinct("node")).alias("deduped"))


@query("three_way_merge", MERGE_SQL + " SELECT execution_id, key, base, ours, theirs, CASE WHEN conflict THEN NULL WHEN ours = base THEN theirs ELSE ours END AS merged, conflict FROM c")
def three_way_merge(spark, d):
    return merged(spark, d)


@query("merge_conflicts", MERGE_SQL + " SELECT execution_id, key, base, ours, theirs FROM c WHERE conflict")
def merge_conflicts(spark, d):
    return merging.conflicts(merged(spark, d))


for _policy, _side in (("abort", "theirs"), ("take_future", "ours")):

    @query(f"commit_trunk_{_policy}", MERGE_SQL + f""", w AS (SELECT *, bool_or(conflict) OVER (PARTITION BY execution_id) AS conflicted FROM c)
SELECT execution_id, key, CASE WHEN conflicted THEN {_side} WHEN ours = base THEN theirs ELSE ours END AS value, conflicted FROM w""")
    def _commit(spark, d, policy=_policy):
        return merging.commit(merged(spark, d), policy)


@query("fork_state", STATES_SQL + ", arms AS (SELECT * FROM (VALUES (0, 10), (1, 20), (2, 15)) t(arm, gain)) SELECT execution_id, arm, key, value + gain * (CASE key WHEN 'k0' THEN 1 ELSE 0 END) AS value FROM states, arms")
def fork_state(spark, d):
    """Every state handed to each arm of a plan's fork; the arms' own step adds to one key. The arms are part of the plan: three rows."""
    arms = F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(g).alias("gain")) for a, g in ((0, 10), (1, 20), (2, 15))))
    forked = state_fold_affine(spark, d).withColumn("a", F.explode(arms))
    return forked.select("execution_id", F.col("a.arm").alias("arm"), "key", (F.col("value") + F.when(F.col("key") == "k0", F.col("a.gain")).otherwise(0)).alias("value"))


# Selection


def candidates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("execution_id"), F.col("o_orderkey").alias("future_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("evaluable").alias("status"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("head"), (F.col("o_orderkey") % 97).alias("cost_ms"), (F.col("o_orderkey") % 3).alias("irreversible_deferred"),
    )


CANDIDATES_SQL = "WITH c AS (SELECT o_custkey AS execution_id, o_orderkey AS future_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'evaluable' END AS status, CAST(floor(o_totalprice / 1000) AS BIGINT) AS head, o_orderkey % 97 AS cost_ms, o_orderkey % 3 AS irreversible_deferred FROM orders)"
SCORES = {"highest_score": "head", "lowest_score": "-head", "cheapest": "-cost_ms", "first_by_identity": "0", "only_without_irreversible": "CASE WHEN irreversible_deferred = 0 THEN head END"}


def _winners(score: str) -> str:
    return CANDIDATES_SQL + f", w AS (SELECT execution_id, future_id, CAST({score} AS BIGINT) AS score, row_number() OVER (PARTITION BY execution_id ORDER BY {score} DESC, future_id) AS r FROM c WHERE status = 'evaluable' AND {score} IS NOT NULL)"


for _name, _score in SCORES.items():

    @query(f"select_{_name}", _winners(_score) + " SELECT execution_id, future_id, score FROM w WHERE r = 1")
    def _select(spark, d, name=_name):
        return selecting.select_future(candidates(spark, d), name)


@query("select_settle", _winners("head") + """ SELECT c.execution_id, c.future_id, CASE WHEN w.future_id IS NULL THEN status WHEN w.future_id = c.future_id THEN 'committed' ELSE 'rejected' END AS status, status AS before
FROM c LEFT JOIN w ON w.execution_id = c.execution_id AND w.r = 1""")
def select_settle(spark, d):
    c = candidates(spark, d)
    return selecting.settle(c, selecting.select_future(c, "highest_score"))


@query("select_next_runnable", "SELECT o_custkey AS execution_id, arg_min(o_orderkey, (o_orderkey % 97, o_orderkey)) AS future_id FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def select_next_runnable(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "blocked").otherwise("failed")
    return selecting.next_runnable(table(spark, d, "orders").select(F.col("o_custkey").alias("execution_id"), F.col("o_orderkey").alias("future_id"), status.alias("status"), (F.col("o_orderkey") % 97).alias("ready_at")))


@query("select_ready", CANDIDATES_SQL + " SELECT execution_id, bool_and(status IN ('evaluable', 'failed', 'rejected', 'committed')) AS ready FROM c GROUP BY ALL")
def select_ready(spark, d):
    return selecting.ready(candidates(spark, d))


@query("percentile_nearest_rank", CANDIDATES_SQL + ", r AS (SELECT execution_id, head, row_number() OVER (PARTITION BY execution_id ORDER BY head) AS r, count(*) OVER (PARTITION BY execution_id) AS n FROM c) SELECT execution_id, head AS value FROM r WHERE r = greatest(1, CAST(ceil(0.95 * n) AS BIGINT))")
def percentile_nearest_rank(spark, d):
    return selecting.nearest_rank(candidates(spark, d), ["execution_id"], "head", 0.95)


# Effects


def recorded(spark: SparkSession, d: str) -> DataFrame:
    """Effects of lineitem: an order is an execution, its lines are the effects of futures 0 (the trunk) to 2."""
    cls = F.array(*map(F.lit, effects.CLASSES))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("execution_id"), (F.col("l_suppkey") % 3).alias("future_id"), F.col("l_linenumber").cast("long").alias("ordinal"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.element_at(cls, (F.col("l_partkey") % 5 + 1).cast("int")).alias("class"),
        F.col("l_quantity").cast("long").alias("args"), (F.col("l_suppkey") % 3 == 0).alias("authoritative"), F.col("l_partkey").alias("part"),
    )


EFFECTS_SQL = """WITH e AS (SELECT l_orderkey AS execution_id, l_suppkey % 3 AS future_id, CAST(l_linenumber AS BIGINT) AS ordinal, l_orderkey * 10 + l_linenumber AS seq,
  CASE l_partkey % 5 WHEN 0 THEN 'pure' WHEN 1 THEN 'read' WHEN 2 THEN 'idempotent_write' WHEN 3 THEN 'compensatable' ELSE 'irreversible' END AS class,
  CAST(floor(l_quantity) AS BIGINT) AS args, l_suppkey % 3 = 0 AS authoritative, l_partkey AS part FROM lineitem),
x AS (SELECT *, CASE WHEN authoritative OR class IN ('pure', 'read', 'idempotent_write') THEN 'performed' ELSE 'deferred' END AS disposition FROM e)"""
EFFECT_COLUMNS = ["execution_id", "future_id", "ordinal", "class", "args", "disposition"]


@query("effect_disposition", EFFECTS_SQL + f" SELECT {', '.join(EFFECT_COLUMNS)} FROM x")
def effect_disposition(spark, d):
    return effects.disposition(recorded(spark, d)).select(*EFFECT_COLUMNS)


@query("effect_keys", EFFECTS_SQL + " SELECT 'e' || execution_id || '/' || CASE WHEN future_id = 0 THEN 'trunk' ELSE (future_id - 1) || '.' || (part % 2) END || '.e' || ordinal AS effect_key FROM x")
def effect_keys(spark, d):
    path = F.when(F.col("future_id") == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("future_id") - 1, F.col("part") % 2).cast("array<int>"))
    return recorded(spark, d).select(effects.effect_key(F.col("execution_id"), path, F.col("ordinal")).alias("effect_key"))




@query("effect_dedup", EFFECTS_SQL + """, t AS (SELECT 'p' || part AS effect_key, seq, class, args, row_number() OVER (PARTITION BY part ORDER BY seq, args) AS r, count(*) OVER (PARTITION BY part) - 1 AS dedup_hits FROM e)
SELECT effect_key, seq, class, CASE WHEN class = 'read' THEN args * 2 + 1 END AS result, dedup_hits FROM t WHERE r = 1""")
def effect_dedup(spark, d):
    attempts = recorded(spark, d).select(F.concat(F.lit("p"), F.col("part").cast("string")).alias("effect_key"), "class", "args", F.struct("seq", "args").alias("seq"))
    return effects.first_results(attempts).select("effect_key", F.col("seq.seq").alias("seq"), "class", "result", "dedup_hits")


@query("effect_pending_release", EFFECTS_SQL + f" SELECT {', '.join(EFFECT_COLUMNS)} FROM x WHERE disposition = 'deferred' AND class NOT IN ('pure', 'read')")
def effect_pending_release(spark, d):
    return effects.pending_release(effects.disposition(recorded(spark, d))).select(*EFFECT_COLUMNS)


@query("effect_owed", EFFECTS_SQL + """, c AS (SELECT DISTINCT execution_id, ordinal FROM x WHERE disposition = 'deferred' AND class NOT IN ('pure', 'read')), r AS (SELECT execution_id, ordinal FROM x WHERE args % 2 = 0)
SELECT * FROM c ANTI JOIN r USING (execution_id, ordinal)""")
def effect_owed(spark, d):
    e = effects.disposition(recorded(spark, d))
    commits = effects.pending_release(e).groupBy("execution_id").agg(F.collect_set("ordinal").alias("release"))
    return effects.owed(commits, e.where("args % 2 = 0").select("execution_id", "ordinal"))


@query("effect_reclaimable", EFFECTS_SQL + """, f AS (SELECT o_orderkey AS execution_id, k AS future_id FROM orders, (VALUES (0), (1), (2)) t(k) WHERE o_orderstatus = 'F')
SELECT """ + ", ".join(EFFECT_COLUMNS) + " FROM x SEMI JOIN f USING (execution_id, future_id) WHERE disposition <> 'deferred'")
def effect_reclaimable(spark, d):
    ended = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("running")
    futures = table(spark, d, "orders").select(F.col("o_orderkey").alias("execution_id"), F.explode(F.expr("sequence(0L, 2L)")).alias("future_id"), ended.alias("status"))
    return effects.reclaimable(effects.disposition(recorded(spark, d)), futures).select(*EFFECT_COLUMNS)


@query("effect_forget", EFFECTS_SQL + """, f AS (SELECT o_orderkey AS execution_id, k AS future_id FROM orders, (VALUES (0), (1), (2)) t(k) WHERE o_orderstatus = 'F')
SELECT """ + ", ".join(EFFECT_COLUMNS) + " FROM x ANTI JOIN f ON x.execution_id = f.execution_id AND x.future_id = f.future_id AND disposition <> 'deferred'")
def effect_forget(spark, d):
    ended = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("running")
    futures = table(spark, d, "orders").select(F.col("o_orderkey").alias("execution_id"), F.explode(F.expr("sequence(0L, 2L)")).alias("future_id"), ended.alias("status"))
    return effects.forget(effects.disposition(recorded(spark, d)), futures).select(*EFFECT_COLUMNS)


@query("effect_attempt_log", EFFECTS_SQL + """, t AS (SELECT *, row_number() OVER w AS r, row_number() OVER w = 1 AND args % 3 = 0 AS fails FROM e WINDOW w AS (PARTITION BY part ORDER BY seq, args)),
n AS (SELECT *, count(CASE WHEN NOT fails THEN 1 END) OVER (PARTITION BY part ORDER BY r) AS n FROM t), f AS (SELECT part, max(CASE WHEN n = 1 AND NOT fails AND class = 'read' THEN args * 2 + 1 END) AS first FROM n GROUP BY part)
SELECT 'p' || part AS effect_key, seq, class, args, CASE WHEN fails THEN 'failed' WHEN n = 1 THEN 'performed' ELSE 'repeated' END AS outcome, CASE WHEN NOT fails THEN first END AS result FROM n JOIN f USING (part)""")
def effect_attempt_log(spark, d):
    attempts = recorded(spark, d).select(F.concat(F.lit("p"), F.col("part").cast("string")).alias("effect_key"), "class", "args", F.struct("seq", "args").alias("seq"))
    return effects.attempt_log(attempts, fails_once=F.col("args") % 3 == 0).withColumn("seq", F.col("seq.seq"))


@query("effect_journal", EFFECTS_SQL + """, j AS (SELECT 'p' || part AS effect_key, seq, args, class, disposition = 'deferred' AS deferred FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY effect_key ORDER BY deferred, CASE WHEN deferred THEN seq ELSE -seq END, CASE WHEN deferred THEN args ELSE -args END) AS r FROM j)
SELECT effect_key, seq, class, args, deferred AND NOT EXISTS (SELECT 1 FROM j i WHERE i.effect_key = k.effect_key AND i.args % 7 = 0) AS deferred FROM k WHERE r = 1""")
def effect_journal(spark, d):
    """What is known of each key: the last result, or the first intent where nothing was done; a seventh of the intents are issued later."""
    e = effects.disposition(recorded(spark, d)).select(F.concat(F.lit("p"), F.col("part").cast("string")).alias("effect_key"), (F.col("seq") * 100 + F.col("args")).alias("seq"), "class", "args", (F.col("disposition") == "deferred").alias("deferred"))
    return effects.journal(e, e.where("args % 7 = 0")).withColumn("seq", F.floor(F.col("seq") / 100))


@query("effect_codes", EFFECTS_SQL + " SELECT execution_id, ordinal, class, CAST(part % 5 AS INTEGER) AS code, class AS name FROM e")
def effect_codes(spark, d):
    number = codes.code(F.col("class"), codes.CLASSES)
    return recorded(spark, d).select("execution_id", "ordinal", "class", number.alias("code"), codes.name_of(number, codes.CLASSES).alias("name"))


@query("effect_classes", EFFECTS_SQL + " SELECT execution_id, class, min(seq) AS first_seq FROM e GROUP BY ALL")
def effect_classes(spark, d):
    return effects.classes_in_order(recorded(spark, d))


@query("effect_sinks", EFFECTS_SQL + """ SELECT execution_id, count(*) AS attempts, count(CASE WHEN disposition = 'performed' THEN 1 END) AS performed, count(CASE WHEN class = 'read' THEN 1 END) AS observable, count(CASE WHEN class <> 'read' THEN 1 END) AS suppressed FROM x GROUP BY ALL""")
def effect_sinks(spark, d):
    """What a performing, an observing and a suppressing sink would each see."""
    e = effects.disposition(recorded(spark, d))
    return e.groupBy("execution_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("disposition") == "performed").alias("performed"), F.count_if(F.col("class") == "read").alias("observable"), F.count_if(F.col("class") != "read").alias("suppressed"))


# Logs


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("execution_id"), F.col("event_id").alias("seq"), (F.octet_length(F.coalesce("props", F.lit(""))) + 8).cast("long").alias("size"), (F.col("event_id") % 97 != 13).alias("valid"))


FRAMES_SQL = "WITH f AS (SELECT user_id AS execution_id, event_id AS seq, strlen(coalesce(props, '')) + 8 AS size, event_id % 97 <> 13 AS valid FROM events), b AS (SELECT execution_id, min(seq) AS bad FROM f WHERE NOT valid GROUP BY ALL), g AS (SELECT f.*, bad FROM f LEFT JOIN b USING (execution_id)), p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY execution_id ORDER BY seq) AS BIGINT) AS end_pos FROM f), o AS (SELECT execution_id, seq, size, valid, end_pos, end_pos - size AS \"offset\" FROM p)"


@query("log_valid_prefix", FRAMES_SQL + " SELECT execution_id, seq, size FROM g WHERE bad IS NULL OR seq < bad")
def log_valid_prefix(spark, d):
    return logs.valid_prefix(frames(spark, d)).select("execution_id", "seq", "size")


@query("log_torn_bytes", FRAMES_SQL + " SELECT execution_id, count(CASE WHEN bad IS NULL OR seq < bad THEN 1 END) AS kept, count(CASE WHEN seq >= bad THEN 1 END) AS dropped, CAST(coalesce(sum(CASE WHEN seq >= bad THEN size END), 0) AS BIGINT) AS torn_bytes FROM g GROUP BY ALL")
def log_torn_bytes(spark, d):
    return logs.torn(frames(spark, d))


FRONTIER = 900
for _name, _test, _f in (("log_commit_prefix", f"end_pos <= {FRONTIER}", logs.commit_prefix), ("log_read_from", f"\"offset\" >= {FRONTIER}", logs.read_from), ("log_truncate_to", f"\"offset\" < {FRONTIER}", logs.truncate_to)):

    @query(_name, FRAMES_SQL + f" SELECT execution_id, seq, \"offset\", end_pos FROM o WHERE {_test}")
    def _positions(spark, d, f=_f):
        return f(logs.offsets(frames(spark, d)), F.lit(FRONTIER)).select("execution_id", "seq", "offset", "end_pos")


@query("log_boundary", FRAMES_SQL + f" SELECT execution_id, bool_or(\"offset\" = {FRONTIER} OR end_pos = {FRONTIER}) AS at_boundary FROM o GROUP BY ALL")
def log_boundary(spark, d):
    return logs.boundary(logs.offsets(frames(spark, d)), F.lit(FRONTIER))


# Stores: four fifths of each user's events are durable, the others are appended

STORE_SQL = """WITH f AS (SELECT user_id AS execution_id, event_id AS seq, strlen(coalesce(props, '')) + 8 AS size, event_id % 5 <> 0 AS old FROM events),
s AS (SELECT *, CAST(sum(size) OVER (PARTITION BY execution_id ORDER BY old DESC, seq) AS BIGINT) AS end_pos FROM f), g AS (SELECT *, end_pos - size AS "offset" FROM s),
l AS (SELECT execution_id, coalesce(max(CASE WHEN old THEN end_pos END), 0) AS sync, max(end_pos) AS written, min(CASE WHEN NOT old THEN end_pos END) AS next, max(CASE WHEN old THEN "offset" END) AS last FROM g GROUP BY ALL)"""


def appended(spark: SparkSession, d: str) -> DataFrame:
    sized = frames(spark, d).select("execution_id", "seq", "size")
    old = logs.offsets(sized.where("seq % 5 <> 0")).withColumn("durable", F.lit(True))
    return store.append(old.select(*store.FRAME), sized.where("seq % 5 = 0"))


@query("store_append", STORE_SQL + ' SELECT execution_id, seq, size, "offset", end_pos, old AS durable FROM g')
def store_append(spark, d):
    return appended(spark, d)


@query("store_ends", STORE_SQL + " SELECT execution_id, written AS written_end, sync AS sync_position FROM l")
def store_ends(spark, d):
    return store.ends(appended(spark, d))


@query("store_commit_prefix", STORE_SQL + ' SELECT execution_id, seq, size, "offset", end_pos, old OR coalesce(end_pos <= next, false) AS durable FROM g JOIN l USING (execution_id)')
def store_commit_prefix(spark, d):
    """One frame more is committed of each log that has one waiting."""
    f = appended(spark, d)
    return store.commit_prefix(f, f.where("not durable").groupBy("execution_id").agg(F.min("end_pos").alias("position")))


@query("store_commit_all", STORE_SQL + " SELECT execution_id, written AS written_end, written AS sync_position FROM l")
def store_commit_all(spark, d):
    return store.ends(store.commit_all(appended(spark, d)))


@query("store_truncate", STORE_SQL + ' SELECT execution_id, seq, size, "offset", end_pos, true AS durable FROM g JOIN l USING (execution_id) WHERE old AND end_pos <= last')
def store_truncate(spark, d):
    """The last durable frame of each log goes, and with it all that is waiting."""
    f = appended(spark, d)
    return store.truncate_to(f, f.where("durable").groupBy("execution_id").agg(F.max("offset").alias("position")))


@query("store_read_from", STORE_SQL + ' SELECT execution_id, seq, size, "offset", end_pos, true AS durable FROM g JOIN l USING (execution_id) WHERE old AND "offset" = last')
def store_read_from(spark, d):
    f = appended(spark, d)
    return store.read_from(f, f.where("durable").groupBy("execution_id").agg(F.max("offset").alias("position")))


@query("store_refused", STORE_SQL + """, p AS (SELECT *, sync + 3 AS position FROM l)
SELECT 'commit' AS action, execution_id, position, CASE WHEN position > written THEN 'beyond the written end' ELSE 'inside a frame' END AS problem FROM p
UNION ALL SELECT 'read', execution_id, position, 'beyond the durable end' FROM p UNION ALL SELECT 'truncate', execution_id, position - 6, 'inside a frame' FROM p WHERE sync > 0""")
def store_refused(spark, d):
    f = appended(spark, d)
    p = store.ends(f).select("execution_id", (F.col("sync_position") + 3).alias("position"), "sync_position")
    back = p.where("sync_position > 0").withColumn("position", F.col("position") - 6)
    told = lambda rows, action: store.refused(f, rows.drop("sync_position"), action).withColumn("action", F.lit(action))
    return told(p, "commit").unionByName(told(p, "read")).unionByName(told(back, "truncate"))


@query("ledger_cost_ms", "SELECT user_id AS execution_id, CASE WHEN max(event_id) * 100 // 1000 > 0 THEN max(event_id) * 100 // 1000 ELSE count(*) END AS cost_ms FROM events GROUP BY ALL")
def ledger_cost_ms(spark, d):
    told = table(spark, d, "events").select(F.col("user_id").alias("execution_id"), F.col("event_id").alias("sequence"), F.lit("step").alias("kind"), (F.col("event_id") * 100).alias("at_us"))
    return logs.cost_ms(told, ["execution_id"])


@query("log_group_commit", FRAMES_SQL + """, w AS (SELECT *, (row_number() OVER (PARTITION BY execution_id ORDER BY seq) - 1) // 8 AS gr FROM f), bt AS (SELECT execution_id, gr, sum(size) AS bytes, count(*) AS n FROM w GROUP BY ALL)
SELECT execution_id, count(*) AS flushes, CAST(sum(bytes) AS BIGINT) AS durable_bytes, CAST(sum(10050 + 20 * ((bytes + 1023) // 1024)) AS BIGINT) AS wait_us, max(n) AS most_waiting FROM bt GROUP BY execution_id""")
def log_group_commit(spark, d):
    return logs.group_commit(frames(spark, d).withColumnRenamed("seq", "sequence"), ["execution_id"], 8)


def steps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("execution_id").orderBy("seq")
    s = operations(spark, d).select("execution_id", "seq", F.when(F.col("seq") % 53 == 5, F.col("seq") - 60).otherwise(F.col("seq")).alias("version"))
    return s.withColumn("parent", F.when(F.col("seq") % 41 == 7, -1).otherwise(F.lag("version", 1, 0).over(w)))


STEPS_SQL = "WITH s AS (SELECT user_id AS execution_id, event_id AS seq, CASE WHEN event_id % 53 = 5 THEN event_id - 60 ELSE event_id END AS version FROM events), t AS (SELECT *, lag(version, 1, 0) OVER (PARTITION BY execution_id ORDER BY seq) AS before, lag(version) OVER (PARTITION BY execution_id ORDER BY seq) AS prior FROM s), p AS (SELECT *, CASE WHEN seq % 41 = 7 THEN -1 ELSE before END AS parent FROM t)"


@query("log_gap_freeze", STEPS_SQL + ", g AS (SELECT *, sum(CASE WHEN parent <> before THEN 1 ELSE 0 END) OVER (PARTITION BY execution_id ORDER BY seq) AS gaps FROM p) SELECT execution_id, seq, version FROM g WHERE gaps = 0")
def log_gap_freeze(spark, d):
    return logs.freeze_at_gaps(steps(spark, d), ["execution_id"]).select("execution_id", "seq", "version")


@query("log_chain_check", STEPS_SQL + " SELECT execution_id, seq, prior AS before, version FROM p WHERE version <= prior")
def log_chain_check(spark, d):
    return logs.chain_breaks(steps(spark, d), ["execution_id"])


@query("ledger_metrics", f"WITH {OPS_SQL} SELECT execution_id, count(*) AS records, " + ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS {k}_records" for k in ("set", "add", "compute", "sleep", "emit", "fail")) + ", min(seq) AS first_seq, max(seq) AS last_seq FROM ops GROUP BY ALL")
def ledger_metrics(spark, d):
    return logs.metrics(operations(spark, d), ["execution_id"])


@query("replay_prefixes", f"""WITH {MAPS_SQL}, n AS (SELECT unnest([0.25, 0.5, 0.75, 1.0]) AS part), m AS (SELECT max(seq) + 1 AS top FROM ops),
c AS (SELECT CAST(floor(part * top) AS BIGINT) AS upto FROM n, m), q AS (SELECT upto, a.* FROM c JOIN a ON a.seq < c.upto)
SELECT upto, execution_id, key, CAST(list_reduce(list_concat([{{s: CAST(0 AS HUGEINT), c: CAST(0 AS HUGEINT)}}], {LIST_SQL}), lambda m, o: {{s: m.s * o.s, c: m.c * o.s + o.c}}).c AS BIGINT) AS value FROM q GROUP BY upto, execution_id, key""")
def replay_prefixes(spark, d):
    """States rebuilt from four prefixes of the log; none is ahead of its prefix. The bounds are one row from one aggregate."""
    ops = operations(spark, d)
    top = ops.agg((F.max("seq") + 1).alias("top"))
    bounds = top.select(F.explode(F.array(*(F.floor(F.lit(p) * F.col("top")) for p in (0.25, 0.5, 0.75, 1.0)))).alias("upto"))
    inside = ops.join(F.broadcast(bounds), ops["seq"] < bounds["upto"])
    return folding.fold_affine(inside, ["upto", *KEY])


# Binary logs: the properties of a user's events are the payloads of one log


@query("frame_checksums", """SELECT event_id, octet_length(encode(props)) AS size, CAST(list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(range(1, strlen(props) + 1), lambda i: CAST(ord(substr(props, i, 1)) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS BIGINT) AS checksum FROM events""")
def frame_checksums(spark, d):
    payload = F.col("props").cast("binary")
    return table(spark, d, "events").select("event_id", F.octet_length(payload).cast("long").alias("size"), binary.fnv1a32(payload).alias("checksum"))


def hurt_logs(spark: SparkSession, d: str) -> DataFrame:
    """A log for each user; a third lose their last three bytes, a third end in eleven bytes of a frame never finished."""
    logs = binary.write_logs(table(spark, d, "events"), "user_id", "event_id", "props")
    last = F.col("block") == F.max("block").over(Window.partitionBy("user_id"))
    torn = F.concat("log", F.lit(bytes([64, 0, 0, 0, 1, 2, 3, 4, 7, 7, 7])))
    hurt = F.when(F.col("user_id") % 3 == 1, F.expr("substring(log, 1, octet_length(log) - 3)")).when(F.col("user_id") % 3 == 2, torn)
    return logs.withColumn("log", F.when(last, F.coalesce(hurt, "log")).otherwise(F.col("log")))


HURT_SQL = """WITH f AS (SELECT user_id, event_id, strlen(props) + 8 AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r,
  sum(strlen(props) + 8) OVER (PARTITION BY user_id ORDER BY event_id) AS end_pos, props FROM events)"""


@query("frame_read", HURT_SQL + " SELECT user_id, ordinal, CAST(end_pos - size AS BIGINT) AS \"offset\", CAST(end_pos AS BIGINT) AS end_pos, props AS payload FROM f WHERE user_id % 3 <> 1 OR r > 1")
def frame_read(spark, d):
    return binary.read_logs(hurt_logs(spark, d), "user_id").withColumn("payload", F.col("payload").cast("string"))


@query("frame_torn_bytes", HURT_SQL + """ SELECT user_id, CAST(coalesce(sum(CASE WHEN user_id % 3 <> 1 OR r > 1 THEN size END), 0) AS BIGINT) AS kept_bytes,
  CAST(CASE user_id % 3 WHEN 1 THEN max(CASE WHEN r = 1 THEN size END) - 3 WHEN 2 THEN 11 ELSE 0 END AS BIGINT) AS torn_bytes FROM f GROUP BY user_id""")
def frame_torn_bytes(spark, d):
    logs = hurt_logs(spark, d)
    return binary.torn_bytes(logs, binary.read_logs(logs, "user_id"), "user_id")


@query("delta_encoded_len", f"""WITH {OPS_SQL}, z AS (SELECT *, CASE WHEN amount >= 0 THEN 2 * amount ELSE -2 * amount - 1 END AS zig, CASE WHEN scale >= 0 THEN 2 * scale ELSE -2 * scale - 1 END AS zag FROM ops)
SELECT execution_id, CAST(sum(CASE kind WHEN 'sleep' THEN 9 WHEN 'emit' THEN 5 + strlen(key) WHEN 'compute' THEN 5 + strlen(key) + 16 ELSE 5 + strlen(key) + 8 END) AS BIGINT) AS raw_bytes,
  CAST(sum(CASE kind WHEN 'sleep' THEN 1 + greatest(1, ceil(len(bin(amount)) / 7)) WHEN 'emit' THEN 2 + strlen(key) ELSE 2 + strlen(key) + greatest(1, ceil(len(bin(zig)) / 7)) + CASE kind WHEN 'compute' THEN greatest(1, ceil(len(bin(zag)) / 7)) ELSE 0 END END) AS BIGINT) AS compact_bytes FROM z GROUP BY ALL""")
def delta_encoded_len(spark, d):
    sized = binary.delta_sizes(operations(spark, d))
    return sized.groupBy("execution_id").agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("compact_bytes").alias("compact_bytes"))


_bytes = lambda x: f"greatest(1, ceil(len(bin({x})) / 7))"


@query("record_round_trip", f"""WITH {OPS_SQL}, z AS (SELECT *, CASE WHEN amount >= 0 THEN 2 * amount ELSE -2 * amount - 1 END AS zig, CASE WHEN scale >= 0 THEN 2 * scale ELSE -2 * scale - 1 END AS zag FROM ops)
SELECT execution_id, seq AS sequence, kind, CASE kind WHEN 'sleep' THEN NULL ELSE key END AS key, CASE kind WHEN 'emit' THEN NULL ELSE amount END AS amount, scale, CAST(NULL AS VARCHAR) AS error,
  CAST(2 + 1 + 1 + {_bytes("execution_id")} + 4 * {_bytes("seq")} + {_bytes("seq * 1000")} + {_bytes("seq % 1000")} + {_bytes("seq - 1")} + 1 + CASE kind WHEN 'sleep' THEN {_bytes("amount")} ELSE 1 + strlen(key) + CASE kind WHEN 'emit' THEN 0 ELSE {_bytes("zig")} END + CASE kind WHEN 'compute' THEN {_bytes("zag")} ELSE 0 END END AS BIGINT) AS bytes FROM z""")
def record_round_trip(spark, d):
    """Each operation as a step's record, written as bytes and read back."""
    o = operations(spark, d).withColumn("key", F.when(F.col("kind") != "sleep", F.col("key")))
    seq, text = F.col("seq"), F.when(F.col("kind") == "sleep", F.lit(None)).otherwise(F.col("key"))
    transition = F.struct(
        "kind", (F.col("execution_id") % 4).alias("future"), seq.alias("step"), F.lit(1).alias("attempt"), (seq - 1).alias("parent"), seq.alias("version"),
        text.alias("key"), "amount", "scale", F.col("amount").alias("ms"),
    )
    rows = o.select("execution_id", seq.alias("version"), seq.alias("sequence"), F.lit(1).alias("attempt"), (seq * 1000).alias("at_us"), F.lit("step").alias("kind"), (seq % 1000).alias("cursor"), transition.alias("transition"))
    back = records.decode(records.encode(rows).select("payload", F.octet_length("payload").cast("long").alias("bytes")))
    sized = records.encode(rows).select("execution_id", "sequence", F.octet_length("payload").cast("long").alias("bytes"))
    t = F.col("transition")
    found = back.select("execution_id", "sequence", t["kind"].alias("kind"), t["key"].alias("key"), F.coalesce(t["amount"], t["ms"]).alias("amount"), t["scale"].alias("scale"), "error")
    return found.join(sized, ["execution_id", "sequence"])


# Plans: every order is an execution, its customer's region of keys and its price are the values that the plan names


def orders_run(spark: SparkSession, d: str, **of) -> Run:
    """Three arms for each order: two of them charge, one reads; the best score is committed to the order's state."""
    price, cust = F.floor("o_totalprice").cast("long"), F.col("o_custkey")
    executions = table(spark, d, "orders").select(F.col("o_orderkey").alias("execution_id"), price.alias("price"), cust.alias("cust"))
    p, c = F.col("price"), F.col("cust")
    arm = lambda by, score: Plan().add("total", by).effect("irreversible", "charge", by).set("score", score)
    plan = (
        Plan().set("total", p).fork(arm(p * 2, p % 11), arm(c, c % 11), Plan().effect("read", "quote", c, reads_into="quoted").compute("total", -1, c).set("score", 7))
        .select("highest_score").commit().add("committed", 1)
    )
    return Run(plan, executions, **of)


PLAN_SQL = """WITH o AS (SELECT o_orderkey AS execution_id, CAST(floor(o_totalprice) AS BIGINT) AS price, o_custkey AS cust FROM orders),
s AS (SELECT *, price % 11 AS s0, cust % 11 AS s1, CAST(7 AS BIGINT) AS s2 FROM o), w AS (SELECT *, CASE WHEN s0 >= s1 AND s0 >= 7 THEN 0 WHEN s1 >= 7 THEN 1 ELSE 2 END AS won FROM s)"""


@query("plan_run_states", PLAN_SQL + """ SELECT execution_id, 'total' AS key, CASE won WHEN 0 THEN price * 3 WHEN 1 THEN price + cust ELSE cust - price END AS value FROM w
UNION ALL SELECT execution_id, 'score', CASE won WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END FROM w UNION ALL SELECT execution_id, 'committed', 1 FROM w UNION ALL SELECT execution_id, 'quoted', cust * 2 FROM w WHERE won = 2""")
def plan_run_states(spark, d):
    return orders_run(spark, d).states()


@query("plan_run_futures", PLAN_SQL + """, f AS (SELECT w.*, unnest([0, 1, 2]) AS arm FROM w)
SELECT execution_id, CAST(arm AS VARCHAR) AS path, arm, CASE WHEN arm = won THEN 'committed' ELSE 'rejected' END AS status, false AS failed, CASE arm WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS score, CAST(3 AS BIGINT) AS steps, CAST(3 AS BIGINT) AS cost_ms,
  CAST(CASE WHEN arm < 2 THEN 1 ELSE 0 END AS BIGINT) AS deferred, CAST(CASE WHEN arm = 2 THEN 1 ELSE 0 END AS BIGINT) AS performed, CAST(CASE WHEN arm < 2 THEN 1 ELSE 0 END AS BIGINT) AS irreversible_deferred FROM f""")
def plan_run_futures(spark, d):
    return orders_run(spark, d).futures()


@query("plan_run_effects", PLAN_SQL + """, f AS (SELECT w.*, unnest([0, 1, 2]) AS arm FROM w)
SELECT execution_id, 'e' || execution_id || '/' || arm || '.e0' AS effect_key, CAST(arm AS VARCHAR) AS path, CAST(0 AS BIGINT) AS ordinal, CASE arm WHEN 2 THEN 'read' ELSE 'irreversible' END AS class, CASE arm WHEN 2 THEN 'quote' ELSE 'charge' END AS op_name,
  CASE arm WHEN 0 THEN price * 2 ELSE cust END AS args, CASE arm WHEN 2 THEN 'performed' ELSE 'deferred' END AS disposition, CASE arm WHEN 2 THEN cust * 2 END AS result, arm < 2 AND arm = won AS released FROM f""")
def plan_run_effects(spark, d):
    return orders_run(spark, d).effects()


for _name, _arms, _write in (("deterministic", 0, "performed"), ("observe", 0, "suppressed"), ("speculative", 3, "performed")):

    @query(f"strategy_{_name}", PLAN_SQL + f""", f AS (SELECT w.*, unnest([0, 1, 2]) AS arm FROM w)
SELECT execution_id, 'e' || execution_id || '/' || arm || '.e0' AS effect_key, CASE WHEN arm = 2 THEN 'read' WHEN arm = won THEN '{_write}' ELSE 'waiting' END AS sink, CASE arm WHEN 2 THEN cust * 2 END AS result FROM f""")
    def _strategy(spark, d, name=_name, arms=_arms):
        return strategies.Strategy(name, arms).issued(orders_run(spark, d)).select("execution_id", "effect_key", "sink", "result")


@query("strategy_agreement", PLAN_SQL + """, v AS (SELECT execution_id, 'effect e' || execution_id || '/' || won || '.e0 irreversible deferred ' AS event FROM w WHERE won < 2)
SELECT 'observe' AS other, execution_id, event || 'performed' AS event, 'a' AS side FROM v UNION ALL SELECT 'observe', execution_id, event || 'suppressed', 'b' FROM v
UNION ALL SELECT 'replay', execution_id, event || 'performed', 'a' FROM v UNION ALL SELECT 'replay', execution_id, event || 'suppressed', 'b' FROM v
UNION ALL SELECT 'replay', execution_id, 'effect e' || execution_id || '/2.e0 read performed ' || (cust * 2) || ' read', 'a' FROM w UNION ALL SELECT 'replay', execution_id, 'effect e' || execution_id || '/2.e0 read performed ' || (cust * 2) || ' suppressed', 'b' FROM w""")
def strategy_agreement(spark, d):
    """What the events of three strategies' runs have unlike the deterministic one: nothing if arms run ahead, released writes if the
    world is only observed, reads besides if a past run is replayed."""
    run, own = orders_run(spark, d), strategies.Strategy("deterministic")
    journal = own.issued(run).select("effect_key", "result")
    others = {"speculative": strategies.Strategy("speculative", 3), "observe": strategies.Strategy("observe"), "replay": strategies.Strategy("replay")}
    found = [strategies.compare(run, own, s, journal).select(F.lit(n).alias("other"), "execution_id", "event", "side") for n, s in others.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("run_metrics", PLAN_SQL + """ SELECT execution_id, CAST(11 AS BIGINT) AS steps_executed, CAST(1 AS BIGINT) AS effects_performed, CAST(2 AS BIGINT) AS effects_deferred, CAST(CASE WHEN won < 2 THEN 1 ELSE 0 END AS BIGINT) AS effects_released,
  CAST(3 AS BIGINT) AS futures_forked, CAST(2 AS BIGINT) AS futures_rejected, CAST(0 AS BIGINT) AS futures_failed, CAST(1 AS BIGINT) AS commits, CAST(0 AS BIGINT) AS commits_with_conflicts, CAST(15 AS BIGINT) AS records FROM w""")
def run_metrics(spark, d):
    return orders_run(spark, d).metrics()


def broken_off(spark: SparkSession, d: str) -> tuple[DataFrame, Run]:
    """Ledgers of which an execution has as many records as its number modulo 16, and the run resumed in a world whose answers are 100 higher."""
    past = stored(rebuild.rollback(orders_run(spark, d).records(), table(spark, d, "orders").select(F.col("o_orderkey").alias("execution_id"), (F.col("o_orderkey") % 16).alias("length"))), "records")
    return past, orders_run(spark, d, bias=100, journal=past)


@query("resume_states", PLAN_SQL + """ SELECT execution_id, 'total' AS key, CASE won WHEN 0 THEN price * 3 WHEN 1 THEN price + cust ELSE cust - price END AS value FROM w
UNION ALL SELECT execution_id, 'score', CASE won WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END FROM w UNION ALL SELECT execution_id, 'committed', 1 FROM w UNION ALL SELECT execution_id, 'quoted', cust * 2 + CASE WHEN execution_id % 16 > 9 THEN 0 ELSE 100 END FROM w WHERE won = 2""")
def resume_states(spark, d):
    """What was read before the break stays as it was read."""
    return broken_off(spark, d)[1].states()


@query("resume_remaining", "SELECT o_orderkey AS execution_id, 15 - o_orderkey % 16 AS records, o_orderkey % 16 AS first FROM orders WHERE o_orderkey % 16 < 15")
def resume_remaining(spark, d):
    past, run = broken_off(spark, d)
    return rebuild.remaining(run.records(), past).groupBy("execution_id").agg(F.count("*").alias("records"), F.min("sequence").alias("first"))


@query("rebuild_states", PLAN_SQL + """, f AS (SELECT w.*, unnest([0, 1, 2]) AS arm FROM w), t AS (SELECT execution_id, arm, won, cust, CASE arm WHEN 0 THEN price * 3 WHEN 1 THEN price + cust ELSE cust - price END AS total, CASE arm WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS score FROM f),
y AS (SELECT *, CAST(arm AS VARCHAR) AS path FROM t UNION ALL SELECT *, '' FROM t WHERE arm = won)
SELECT execution_id, path, 'total' AS key, total AS value FROM y UNION ALL SELECT execution_id, path, 'score', score FROM y UNION ALL SELECT execution_id, path, 'quoted', cust * 2 FROM y WHERE arm = 2 UNION ALL SELECT execution_id, '', 'committed', 1 FROM w""")
def rebuild_states(spark, d):
    return rebuild.states(stored(orders_run(spark, d).records(), "records")).select("execution_id", named("path"), "key", "value")


@query("rebuild_commit_check", PLAN_SQL + " SELECT execution_id, CAST(13 AS BIGINT) AS sequence, 'score' AS key, CASE won WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END + 1 AS recorded, CASE won WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS recomputed FROM w WHERE execution_id % 10 = 3")
def rebuild_commit_check(spark, d):
    """A tenth of the commits have a wrong score recorded; just these must be told."""
    wrong = F.expr("transform(changes, c -> named_struct('key', c.key, 'value', c.value + if(c.key = 'score' and execution_id % 10 = 3, 1L, 0L)))")
    records = stored(orders_run(spark, d).records().withColumn("changes", wrong), "records")
    return rebuild.commit_mismatches(records)


@query("rebuild_violations", "SELECT o_orderkey AS execution_id, CAST(unnest([2, 3, 4]) AS BIGINT) AS sequence, 'before its fork' AS problem FROM orders WHERE o_orderkey % 10 = 7")
def rebuild_violations(spark, d):
    """In a tenth of the ledgers the fork comes behind the first arm's three records; just these must be told."""
    moved = F.when((F.col("execution_id") % 10 == 7) & F.col("sequence").between(2, 5), F.when(F.col("sequence") == 2, 5).otherwise(F.col("sequence") - 1)).otherwise(F.col("sequence"))
    return rebuild.violations(stored(orders_run(spark, d).records().withColumn("sequence", moved.cast("long")), "records"))


def nested_run(spark: SparkSession, d: str) -> Run:
    """The states of executions folded from events go through a fork whose first arm forks again."""
    h = F.col("held")
    inner = Plan().fork(Plan().add("k0", h), Plan().compute("k0", -1, 9)).select("lowest_score", "k0").commit().add("k1", 2)
    return Run(Plan().fork(inner, Plan().set("k1", h % 7)).select("highest_score", "k1").add("k2", 1).commit("take_future").compute("k2", 3, 1), None, state_fold_affine(spark, d), values={"held": F.sum("value")})


@query("plan_nested_states", STATES_SQL + """, e AS (SELECT execution_id, CAST(sum(value) AS BIGINT) AS h, max(CASE key WHEN 'k0' THEN value END) AS k0, max(CASE key WHEN 'k1' THEN value END) AS k1, max(CASE key WHEN 'k2' THEN value END) AS k2 FROM states GROUP BY ALL),
n AS (SELECT *, least(coalesce(k0, 0) + h, 9 - coalesce(k0, 0)) AS i0, coalesce(k1, 0) + 2 AS i1 FROM e), w AS (SELECT *, i1 >= h % 7 AS first FROM n)
SELECT execution_id, 'k0' AS key, CASE WHEN first THEN i0 ELSE k0 END AS value FROM w WHERE first OR k0 IS NOT NULL
UNION ALL SELECT execution_id, 'k1', CASE WHEN first THEN i1 ELSE h % 7 END FROM w UNION ALL SELECT execution_id, 'k2', 3 * (coalesce(k2, 0) + 1) + 1 FROM w""")
def plan_nested_states(spark, d):
    return nested_run(spark, d).states()


# Lineage


def tree(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    path = F.slice(F.array(c % 3, (c / 3).cast("long") % 3, (c / 9).cast("long") % 3).cast("array<int>"), F.lit(1), (c % 4).cast("int"))
    status = F.when(c % 5 == 0, "running").when(c % 5 == 1, "blocked").when(c % 5 == 2, "committed").otherwise("rejected")
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("execution_id"), path.alias("path"), status.alias("status")).dropDuplicates(["execution_id", "path", "status"])


TREE_SQL = """WITH f AS (SELECT DISTINCT c_nationkey AS execution_id, list_slice([c_custkey % 3, (c_custkey // 3) % 3, (c_custkey // 9) % 3], 1, c_custkey % 4) AS path,
  CASE c_custkey % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'blocked' WHEN 2 THEN 'committed' ELSE 'rejected' END AS status FROM customer)"""


@query("lineage_ancestors", TREE_SQL + ", a AS (SELECT execution_id, path, status, unnest(range(1, len(path) + 1)) AS distance FROM f) SELECT execution_id, array_to_string(path, '.') AS path, CAST(distance AS INTEGER) AS distance, array_to_string(list_slice(path, 1, len(path) - distance), '.') AS ancestor FROM a")
def lineage_ancestors(spark, d):
    return lineage.ancestors(tree(spark, d)).select("execution_id", named("path"), "distance", named("ancestor"))


@query("lineage_subtree", TREE_SQL + " SELECT execution_id, array_to_string(path, '.') AS path, status FROM f WHERE path[1] = 1")
def lineage_subtree(spark, d):
    return lineage.subtree(tree(spark, d), [1]).select("execution_id", named("path"), "status")


@query("lineage_live", TREE_SQL + " SELECT execution_id, array_to_string(path, '.') AS path, status FROM f WHERE status IN ('running', 'blocked')")
def lineage_live(spark, d):
    return lineage.live(tree(spark, d)).select("execution_id", named("path"), "status")


@query("lineage_remove", TREE_SQL + " SELECT execution_id, array_to_string(path, '.') AS path, status FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.execution_id = f.execution_id AND g.status = 'rejected' AND len(g.path) <= len(f.path) AND len(g.path) > 0 AND g.path = list_slice(f.path, 1, len(g.path)))")
def lineage_remove(spark, d):
    t = tree(spark, d)
    return lineage.remove(t, t.where("status = 'rejected' and size(path) > 0").select("execution_id", "path")).select("execution_id", named("path"), "status")


@query("lineage_alternatives", TREE_SQL + " SELECT execution_id, array_to_string(list_slice(path, 1, len(path) - 1), '.') AS parent, count(*) AS arms, bool_and(status IN ('committed', 'rejected')) AS settled FROM f WHERE len(path) > 0 GROUP BY ALL")
def lineage_alternatives(spark, d):
    return lineage.alternatives(tree(spark, d)).select("execution_id", named("parent"), "arms", "settled")


@query("lineage_retain", "SELECT DISTINCT n.c_nationkey AS execution_id, n.c_custkey % 50 AS node FROM customer n JOIN customer f ON n.c_nationkey = f.c_nationkey AND (n.c_custkey % 50 = f.c_custkey % 7 OR n.c_custkey % 50 = f.c_custkey % 11)")
def lineage_retain(spark, d):
    c = F.col("c_custkey")
    own = table(spark, d, "customer").withColumnRenamed("c_nationkey", "execution_id")
    return lineage.retain(own.select("execution_id", (c % 50).alias("node")).distinct(), own.select("execution_id", (c % 7).alias("base"), (c % 11).alias("head")))


@query("lineage_depth", TREE_SQL + " SELECT execution_id, CAST(max(len(path)) AS INTEGER) AS depth FROM f GROUP BY ALL")
def lineage_depth(spark, d):
    return lineage.depth(tree(spark, d))


@query("lineage_orphans", TREE_SQL + " SELECT execution_id, array_to_string(path, '.') AS path, status FROM f WHERE len(path) > 0 AND NOT EXISTS (SELECT 1 FROM f p WHERE p.execution_id = f.execution_id AND p.path = list_slice(f.path, 1, len(f.path) - 1))")
def lineage_orphans(spark, d):
    return lineage.orphans(tree(spark, d)).select("execution_id", named("path"), "status")


# Contracts: a signup expects a purchase within twelve hours and forbids more than one error

CONTRACT_SQL = """WITH i AS (SELECT user_id, min(ts) AS opened_at, arg_min(event_id, (ts, event_id)) AS opened_by FROM events WHERE event_type = 'signup' GROUP BY ALL),
x AS (SELECT i.*, opened_at + INTERVAL 12 HOUR AS due_at, (SELECT min(ts) FROM events e WHERE e.user_id = i.user_id AND e.event_type = 'purchase' AND e.ts > opened_at AND e.ts <= opened_at + INTERVAL 12 HOUR) AS seen_at FROM i),
v AS (SELECT user_id, opened_by, count(CASE WHEN e.ts > opened_at THEN 1 END) AS hits FROM i LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'error') e USING (user_id) GROUP BY ALL),
t AS (SELECT max(ts) - INTERVAL 1 DAY AS as_of FROM events)"""


def opened(spark, d) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    return events, contracts.instances(events, "signup")


def as_of(expected: DataFrame, events: DataFrame) -> DataFrame:
    """expected with as_of, a day before the last event: one row from one aggregate, broadcast."""
    return expected.join(F.broadcast(events.agg((F.max("ts") - F.expr("interval 1 day")).alias("as_of"))))


@query("contract_instances", CONTRACT_SQL + " SELECT user_id, opened_at, opened_by FROM i")
def contract_instances(spark, d):
    return opened(spark, d)[1]


@query("contract_expectations", CONTRACT_SQL + " SELECT user_id, opened_at, opened_by, due_at, seen_at FROM x")
def contract_expectations(spark, d):
    events, i = opened(spark, d)
    return contracts.expectations(i, events, "purchase", "12 hours")


@query("contract_forbids", CONTRACT_SQL + " SELECT user_id, opened_by, hits, hits > 1 AS violated FROM v")
def contract_forbids(spark, d):
    events, i = opened(spark, d)
    return contracts.forbidden(i, events, "error", 1)


@query("contract_outcomes", CONTRACT_SQL + " SELECT user_id, opened_by, CASE WHEN hits > 1 THEN 'violated' WHEN seen_at IS NOT NULL THEN 'satisfied' WHEN due_at <= as_of THEN 'breached' ELSE 'open' END AS outcome FROM x JOIN v USING (user_id, opened_by), t")
def contract_outcomes(spark, d):
    events, i = opened(spark, d)
    expected = as_of(contracts.expectations(i, events, "purchase", "12 hours"), events)
    return contracts.outcomes(expected, contracts.forbidden(i, events, "error", 1), F.col("as_of")).select("user_id", "opened_by", "outcome")


@query("contract_sweep", CONTRACT_SQL + " SELECT user_id, opened_by, due_at FROM x, t WHERE seen_at IS NULL AND due_at <= as_of")
def contract_sweep(spark, d):
    events, i = opened(spark, d)
    expected = as_of(contracts.expectations(i, events, "purchase", "12 hours"), events)
    return contracts.sweep(expected, F.col("as_of")).select("user_id", "opened_by", "due_at")


@query("contract_breaches_recent", CONTRACT_SQL + " SELECT user_id, opened_by, due_at FROM x, t WHERE seen_at IS NULL AND due_at <= as_of ORDER BY due_at DESC, opened_by DESC LIMIT 20")
def contract_breaches_recent(spark, d):
    """The newest twenty breaches: a report, so its limit is its feature."""
    return contract_sweep(spark, d).orderBy(F.desc("due_at"), F.desc("opened_by")).limit(20)


@query("contract_escalations", CONTRACT_SQL + " SELECT user_id, opened_by, count(*) AS errors_after FROM x JOIN events e USING (user_id) CROSS JOIN t WHERE seen_at IS NULL AND due_at <= as_of AND e.event_type = 'error' AND e.ts > due_at GROUP BY ALL")
def contract_escalations(spark, d):
    """A second contract that a breach triggers: errors behind the deadline."""
    errors = table(spark, d, "events").where("event_type = 'error'").select("user_id", "ts")
    return contract_sweep(spark, d).join(errors, "user_id").where("ts > due_at").groupBy("user_id", "opened_by").agg(F.count("*").alias("errors_after"))


@query("contract_dedupe", """WITH k AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN event_type || '-' || CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) END AS dedupe_key FROM events)
SELECT user_id, dedupe_key, event_id FROM k WHERE dedupe_key IS NULL UNION ALL SELECT user_id, dedupe_key, min(event_id) FROM k WHERE dedupe_key IS NOT NULL GROUP BY ALL""")
def contract_dedupe(spark, d):
    key = F.when(F.col("event_type") != "view", F.concat_ws("-", "event_type", (F.floor("value").cast("long") % 10).cast("string")))
    keyed = table(spark, d, "events").select("user_id", key.alias("dedupe_key"), "event_id")
    return contracts.dedupe(keyed, "user_id", "dedupe_key", "event_id").select("user_id", "dedupe_key", "event_id")


# Contracts as a table: users are dealt to three tenants, each with contracts of its own; two follow another's breaches

HOUR = 3_600_000
#: tenant, contract, trigger, where, expects, forbids, deadline, the contract whose breach opens it
CONTRACTS = (
    ("t0", "onboarding", "signup", {"parity": "0"}, [("purchase", 12 * HOUR, True), ("view", 6 * HOUR, False), ("click", 30 * HOUR, False)], [("error", 14)], 24 * HOUR, None),
    ("t1", "onboarding", "signup", None, [("purchase", 60 * HOUR, True)], [("error", 15), ("purchase", 16)], None, None),
    ("t0", "care", "error", {"kind": "error", "parity": "1"}, [("click", 8 * HOUR, True)], [], None, None),
    ("t0", "recovery", None, None, [("purchase", 96 * HOUR, True), ("purchase", 72 * HOUR, False)], [("signup", 12)], None, "onboarding"),
    ("t0", "alarm", None, None, [("view", 3 * HOUR, True)], [], None, "recovery"),
    ("t2", "audit", "purchase", None, [], [("error", 12)], None, None),
)


def contract_rows(spark: SparkSession, rows=CONTRACTS) -> DataFrame:
    schema = "tenant string, contract string, trigger string, where map<string,string>, expects array<struct<event:string,within_ms:bigint,critical:boolean>>, forbids array<struct<event:string,more_than:bigint>>, deadline_ms long, after_breach_of string"
    return spark.createDataFrame(list(rows), schema)


def judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    last = e.agg(F.max("ts") - F.expr("interval 1 day")).first()[0]
    payload = F.create_map(F.lit("parity"), (F.col("event_id") % 2).cast("string"), F.lit("kind"), F.col("event_type"))
    own = e.select(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant"), "event_id", "event_type", "ts", F.col("user_id").alias("correlation"), payload.alias("payload"))
    return contract_table.judge(own, contract_rows(spark), F.expr(f"timestamp_ntz'{last}'"))


def _values(rows, columns: str) -> str:
    put = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(put, r)) + ')' for r in rows)}) v({columns}))"


def _level_sql(n: int) -> str:
    """The instances, expectations, prohibitions, breaches and outcomes of a level."""
    first = """SELECT e.tenant, c.contract, e.correlation, min(ts) AS opened_at, arg_min(event_id, (ts, event_id)) AS opened_by FROM e JOIN c ON c.tenant = e.tenant AND c.trigger = e.event_type
  WHERE NOT EXISTS (SELECT 1 FROM wh WHERE wh.tenant = c.tenant AND wh.contract = c.contract AND wh.v <> CASE wh.k WHEN 'parity' THEN CAST(e.event_id % 2 AS VARCHAR) ELSE e.event_type END) GROUP BY ALL"""
    later = f"SELECT b.tenant, c.contract, b.correlation, min(b.observed_at) AS opened_at, CAST(NULL AS BIGINT) AS opened_by FROM b{n - 1} b JOIN c ON c.tenant = b.tenant AND c.after = b.contract GROUP BY ALL"
    return f"""i{n} AS ({later if n else first}),
x{n} AS (SELECT i.*, t.n, t.event, t.critical, i.opened_at + to_milliseconds(least(within_ms, coalesce(c.deadline, within_ms))) AS due_at FROM i{n} i JOIN ex t USING (tenant, contract) JOIN c USING (tenant, contract)),
s{n} AS (SELECT x.tenant, x.contract, x.correlation, x.n, x.event, x.critical, x.opened_at, x.due_at, min(CASE WHEN e.ts > opened_at AND e.ts <= due_at THEN e.ts END) AS seen_at FROM x{n} x LEFT JOIN e ON e.tenant = x.tenant AND e.correlation = x.correlation AND e.event_type = x.event GROUP BY ALL),
h{n} AS (SELECT i.tenant, i.contract, i.correlation, t.n, t.event, t.more_than, e.ts, row_number() OVER (PARTITION BY i.tenant, i.contract, i.correlation, t.n ORDER BY e.ts, e.event_id) AS r FROM i{n} i JOIN fo t USING (tenant, contract) JOIN e ON e.tenant = i.tenant AND e.correlation = i.correlation AND e.event_type = t.event AND e.ts > i.opened_at),
v{n} AS (SELECT tenant, contract, correlation, n, event, min(ts) AS violated_at FROM h{n} WHERE r > more_than GROUP BY ALL),
b{n} AS (SELECT tenant, contract, correlation, 'missing' AS kind, n, event, due_at AS observed_at FROM s{n}, t WHERE seen_at IS NULL AND due_at <= as_of UNION ALL SELECT tenant, contract, correlation, 'forbidden', n, event, violated_at FROM v{n}),
a{n} AS (SELECT tenant, contract, correlation, count(CASE WHEN seen_at IS NULL THEN 1 END) AS unseen, max(seen_at) AS last, min(CASE WHEN seen_at IS NULL THEN due_at END) AS missed FROM s{n} GROUP BY ALL),
w{n} AS (SELECT tenant, contract, correlation, min(violated_at) AS violated FROM v{n} GROUP BY ALL),
o{n} AS (SELECT i.*, CASE WHEN violated IS NOT NULL THEN 'violated' WHEN coalesce(unseen, 0) = 0 THEN 'satisfied' WHEN missed <= as_of THEN 'breached' ELSE 'open' END AS status,
  CASE WHEN violated IS NOT NULL THEN violated WHEN coalesce(unseen, 0) = 0 THEN coalesce(last, opened_at) WHEN missed <= as_of THEN missed END AS closed_at FROM i{n} i LEFT JOIN a{n} USING (tenant, contract, correlation) LEFT JOIN w{n} USING (tenant, contract, correlation), t)"""


JUDGED_SQL = f"""WITH t AS (SELECT max(ts) - INTERVAL 1 DAY AS as_of FROM events), e AS (SELECT 't' || user_id % 3 AS tenant, event_id, event_type, ts, user_id AS correlation FROM events, t WHERE ts <= as_of),
c AS {_values([(r[0], r[1], r[2], r[6], r[7]) for r in CONTRACTS], "tenant, contract, trigger, deadline, after")},
wh AS {_values([(r[0], r[1], k, v) for r in CONTRACTS for k, v in (r[3] or {}).items()], "tenant, contract, k, v")},
ex AS {_values([(r[0], r[1], n, *x) for r in CONTRACTS for n, x in enumerate(r[4])], "tenant, contract, n, event, within_ms, critical")},
fo AS {_values([(r[0], r[1], n, *x) for r in CONTRACTS for n, x in enumerate(r[5])], "tenant, contract, n, event, more_than")},
{", ".join(map(_level_sql, range(3)))}"""


@query("contract_multi", JUDGED_SQL + " SELECT * FROM o0 UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o2")
def contract_multi(spark, d):
    """The outcome of every instance of every contract, those that breaches open included."""
    return judged(spark, d)[0]


@query("contract_escalation_chain", JUDGED_SQL + " SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2")
def contract_escalation_chain(spark, d):
    """Every breach, of the contracts that follow others too."""
    return judged(spark, d)[1]
