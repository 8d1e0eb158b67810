"""Literal fixtures of the operators, and every query against its SQL twin."""

import datetime as dt
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomstate import catalog
from loomstate.operators import contracts, effects, folding, lineage, logs, merging, selecting
from loomstate.streaming import ledger_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def ops(spark, rows):
    """rows: (kind, key, amount) or, for computes, (kind, key, amount, scale)."""
    return spark.createDataFrame([(1, i, *r, *[None] * (4 - len(r))) for i, r in enumerate(rows)], "execution_id long, seq long, kind string, key string, amount long, scale long")


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


def plain_fold(log):
    """(seq, key, value) after each operation that touches a key."""
    state, told = {}, []
    for i, (kind, key, amount, *scale) in enumerate(log):
        if kind in ("sleep", "fail"):
            continue
        key, amount = ("__emit__", 1) if kind == "emit" else (key, amount)
        state[key] = state.get(key, 0) * {"set": 0, "compute": (scale or [None])[0]}.get(kind, 1) + amount
        assert -(2**63) <= state[key] < 2**63
        told.append((i, key, state[key]))
    return state, told


def random_log(seed, n=120, kinds=("set", "add", "add", "compute", "sleep", "emit")):
    rng = random.Random(seed)
    log = []
    while len(log) < n:
        kind, key = rng.choice(kinds), rng.choice("xxxy")
        run = rng.randint(1, 5)
        log += [(kind, key, rng.randint(-9, 9), *([rng.choice((2, 3, -1, 0, 1, -2))] if kind == "compute" else [])) for _ in range(run)]
    return log[:n]


def test_fold_is_ordered(spark):
    log = ops(spark, [("add", "x", 1), ("add", "x", 1), ("compute", "x", -4, 10), ("sleep", "x", 0), ("add", "x", 10)])
    assert rows(folding.fold_affine(log, ["execution_id", "key"])) == [(1, "x", 26)]
    assert rows(folding.fold_affine(ops(spark, [("set", "x", 5), ("compute", "x", 1, 3)]), ["key"])) == [("x", 16)]
    log = ops(spark, [("emit", "shipped", None), ("sleep", None, 9), ("emit", "paid", None), ("add", "x", 2), ("fail", "why", None)])
    assert sorted(rows(folding.fold_affine(log, ["key"]))) == [("__emit__", 2), ("x", 2)]


@pytest.mark.parametrize("log", [[("set", "x", 2**63 - 1), ("add", "x", 1)], [("set", "x", 2**62), ("compute", "x", 0, 2)], [("set", "x", -(2**63)), ("compute", "x", 0, -1)]])
def test_overflow_is_an_error(spark, log):
    for fold in (folding.fold_affine, folding.prefix_states):
        with pytest.raises(Exception, match="OVERFLOW|64 bits"):
            fold(ops(spark, log), ["key"]).collect()


def test_values_may_stay_where_their_maps_leave_64_bits(spark):
    """A compute that keeps a value in place, seventy times: the composed map is 2^70 x - c(2^70 - 1)."""
    log = [("set", "x", 7)] + [("add", "y", 0)] * folding.PART + [("compute", "x", -7, 2)] * 70 + [("add", "x", 1)]
    assert sorted(rows(folding.fold_affine(ops(spark, log), ["key"]))) == [("x", 8), ("y", 0)]
    found = folding.prefix_states(ops(spark, log), ["key"]).where("key = 'x'").select("value").distinct()
    assert sorted(rows(found)) == [(7,), (8,)]


@pytest.mark.parametrize("part", [4096, 7, 1])
def test_parts_make_no_difference(spark, monkeypatch, part):
    monkeypatch.setattr(folding, "PART", part)
    for seed in range(2):
        log = random_log(seed)
        state, told = plain_fold(log)
        assert dict(rows(folding.fold_affine(ops(spark, log), ["key"]))) == state
        assert rows(folding.prefix_states(ops(spark, log), ["key"]).select("seq", "key", "value"), "seq") == told
        sums = random_log(seed, kinds=("set", "add", "emit", "sleep"))
        state, told = plain_fold(sums)
        assert dict(rows(folding.fold_closed(ops(spark, sums), ["key"]))) == state
        assert rows(folding.prefix_sums(ops(spark, sums), ["key"]).select("seq", "key", "value"), "seq") == told


def test_closed_forms_refuse_computes(spark):
    for fold in (folding.fold_closed, folding.prefix_sums):
        with pytest.raises(Exception, match="no closed form"):
            fold(ops(spark, [("add", "x", 1), ("compute", "x", 1, 2)]), ["key"]).collect()
    with pytest.raises(Exception, match="without a scale"):
        folding.fold_affine(ops(spark, [("compute", "x", 1)]), ["key"]).collect()


@pytest.mark.parametrize(
    "log, expected",
    [
        ([("add", "x", 1)] * 3 + [("add", "x", -1)], [("compute", 1, 2)]),
        ([("add", "x", 1), ("add", "x", -1)], []),
        ([("add", "x", 1), ("sleep", "x", 0), ("add", "x", 1)], [("add", 1, 1), ("sleep", 1, 0), ("add", 1, 1)]),
        ([("add", "a", 1), ("add", "b", 1), ("add", "a", 1)], [("add", 1, 1)] * 3),
        ([("set", "x", 10), ("add", "x", 5)], [("compute", 0, 15)]),
        ([("add", "x", 0)], []),
        ([("set", "x", 2**63 - 1), ("add", "x", 2**63 - 1)], [("set", 0, 2**63 - 1), ("add", 1, 2**63 - 1)]),
        ([("compute", "x", 1, 3), ("compute", "x", 2, -2)], [("compute", -6, 0)]),
        # the run so far goes out, then what breaks it as it is, and the next begins anew
        ([("add", "x", a) for a in (2**62, 5, 2**62, 7, 8)], [("compute", 1, 2**62 + 5), ("add", 1, 2**62), ("compute", 1, 15)]),
        ([("compute", "x", 0, 2**40)] * 4, [("compute", 2**40, 0)] * 4),
        ([("set", "x", 2**63 - 1), ("add", "x", 1), ("add", "x", 0)], [("set", 0, 2**63 - 1), ("add", 1, 1)]),
    ],
)
def test_coalescing(spark, log, expected):
    found = folding.coalesce_runs(ops(spark, log)).orderBy("seq").select("kind", "scale", "amount")
    assert rows(found) == expected


@pytest.mark.parametrize("part", [4096, 3])
def test_coalesced_ledgers_fold_to_the_same(spark, monkeypatch, part):
    monkeypatch.setattr(folding, "PART", part)
    for seed in range(3):
        log = ops(spark, random_log(seed))
        folded = folding.coalesce_runs(log)
        same = lambda df: {k: v for k, v in rows(folding.fold_affine(df, ["key"])) if v}
        assert same(folded) == same(log) and folded.count() < log.count()
        assert rows(folding.coalesce_runs(folded), "seq") == rows(folded.withColumn("folded", F.lit(1).cast("long")), "seq")


@pytest.mark.parametrize("part", [4096, 3])
def test_runs_over_parts(spark, monkeypatch, part):
    monkeypatch.setattr(folding, "PART", part)
    for seed in range(2):
        log, told, start = random_log(seed), [], 0
        for i, (kind, key, *_) in enumerate(log):
            if i == 0 or kind in ("sleep", "emit") or log[i - 1][0] in ("sleep", "emit") or log[i - 1][1] != key:
                start = i
            told.append((i, start))
        assert rows(folding.runs(ops(spark, log)).select("seq", "run"), "seq") == told


def state(spark, **values):
    return spark.createDataFrame([(1, k, v) for k, v in values.items()], "execution_id long, key string, value long")


def test_diff_and_equality(spark):
    a, b = state(spark, x=1, y=2), state(spark, x=1, y=3, z=4)
    assert rows(merging.diff(a, b), "key") == [(1, "y", 2, 3), (1, "z", 0, 4)]
    assert rows(merging.logically_equal(state(spark, x=0), state(spark, y=0))) == [(1, False)]


def test_merge(spark):
    found = merging.merge(state(spark, a=1, b=1), state(spark, a=5), state(spark, b=9, a=1))
    assert {r["key"]: r["merged"] for r in found.collect()} == {"a": 5, "b": None}
    clash = merging.merge(state(spark, s=1, t=1), state(spark, s=5, t=6), state(spark, s=7, t=6))
    assert rows(merging.conflicts(clash)) == [(1, "s", 1, 5, 7)]
    assert {r["key"]: r["value"] for r in merging.commit(clash, "take_future").collect()} == {"s": 5, "t": 6}
    assert {r["key"]: r["value"] for r in merging.commit(clash).collect()} == {"s": 7, "t": 6}


def test_selection_ties_and_refusals(spark):
    schema = "execution_id long, future_id long, status string, head long, cost_ms long, irreversible_deferred long"
    c = spark.createDataFrame([(1, 7, "evaluable", 3, 5, 1), (1, 4, "evaluable", 3, 9, 1), (1, 2, "failed", 99, 0, 0), (2, 1, "evaluable", 10, 1, 0), (2, 2, "evaluable", 20, 1, 1)], schema)
    pick = lambda name: {r["execution_id"]: r["future_id"] for r in selecting.select_future(c, name).collect()}
    assert pick("highest_score") == {1: 4, 2: 2}
    assert pick("lowest_score") == {1: 4, 2: 1}
    assert pick("cheapest") == {1: 7, 2: 1}
    assert pick("first_by_identity") == {1: 4, 2: 1}
    assert pick("only_without_irreversible") == {2: 1}
    done = selecting.settle(c, selecting.select_future(c, "highest_score"))
    assert rows(done.where("execution_id = 1").select("future_id", "status", "before"), "future_id") == [(2, "rejected", "failed"), (4, "committed", "evaluable"), (7, "rejected", "evaluable")]
    assert rows(selecting.settle(c, selecting.select_future(c, F.lit(None))).select("status", "before").distinct(), "status") == [("evaluable", "evaluable"), ("failed", "failed")]
    waiting = spark.createDataFrame([(1, 5, "running", 7), (1, 3, "running", 7), (1, 1, "blocked", 0), (1, 2, "failed", 0), (2, 1, "committed", 0)], "execution_id long, future_id long, status string, ready_at long")
    assert rows(selecting.next_runnable(waiting)) == [(1, 3)]


def test_effects(spark):
    key = spark.createDataFrame([(7, [2, 0], 3), (1, [], 4)], "e long, p array<int>, o long").select(effects.effect_key(F.col("e"), F.col("p"), F.col("o")))
    assert rows(key) == [("e7/2.0.e3",), ("e1/trunk.e4",)]
    tries = spark.createDataFrame([("k", 1, "read", 10), ("k", 2, "read", 99), ("w", 3, "irreversible", 1)], "effect_key string, seq long, class string, args long")
    assert rows(effects.first_results(tries), "effect_key") == [("k", 1, "read", 21, 1), ("w", 3, "irreversible", None, 0)]


def test_attempts_and_journal(spark):
    schema = "effect_key string, seq long, class string, args long, deferred boolean"
    tries = spark.createDataFrame([("k", 1, "read", 10, False), ("k", 2, "read", 99, False), ("k", 3, "read", 7, False), ("w", 4, "irreversible", 1, False), ("w", 5, "irreversible", 1, False)], schema)
    found = effects.attempt_log(tries, fails_once=F.col("effect_key") == "k").select("seq", "outcome", "result")
    assert rows(found, "seq") == [(1, "failed", None), (2, "performed", 199), (3, "repeated", 199), (4, "performed", None), (5, "repeated", None)]
    assert rows(effects.first_results(tries, bias=0).select("effect_key", "result"), "effect_key") == [("k", 20), ("w", None)]
    intents = spark.createDataFrame([("a", 1, "irreversible", 5, True), ("a", 2, "irreversible", 6, True), ("b", 3, "read", 1, False), ("b", 4, "read", 2, False), ("b", 5, "irreversible", 3, True)], schema)
    assert rows(effects.journal(intents).select("effect_key", "args", "deferred"), "effect_key") == [("a", 5, True), ("b", 2, False)]
    assert rows(effects.journal(intents, intents.where("effect_key = 'a'")).select("effect_key", "deferred"), "effect_key") == [("a", False), ("b", False)]


def test_lineage_removes_what_is_below(spark):
    tree = spark.createDataFrame([(1, p, "evaluable") for p in ([], [0], [1], [0, 0], [0, 1], [1, 0], [0, 1, 2])], "execution_id long, path array<int>, status string")
    gone = spark.createDataFrame([(1, [0, 1]), (2, [1])], "execution_id long, path array<int>")
    assert sorted(r["path"] for r in lineage.remove(tree, gone).collect()) == [[], [0], [0, 0], [1], [1, 0]]
    assert rows(lineage.alternatives(tree).select("parent", "arms", "settled"), "parent") == [([], 2, True), ([0], 2, True), ([0, 1], 1, True), ([1], 1, True)]


def test_costs(spark):
    told = spark.createDataFrame([(1, 0, "step", 9000), (1, 1, "step", 2500), (2, 0, "step", 0), (2, 1, "settled", 900)], "execution_id long, sequence long, kind string, at_us long")
    assert rows(logs.cost_ms(told, ["execution_id"]), "execution_id") == [(1, 2), (2, 1)]
    sizes = spark.range(178).selectExpr("1L as execution_id", "id as sequence", "22L as size")
    cost = lambda n: rows(logs.group_commit(sizes, ["execution_id"], n, flush_us=5000))[0]
    assert cost(1) == (1, 178, 3916, 902_460, 1) and cost(8)[1:] == (23, 3916, 23 * 5070, 8) and cost(1000)[1] == 1


def test_log_prefixes(spark):
    f = spark.createDataFrame([(1, i, 10, i != 3) for i in range(5)], "execution_id long, seq long, size long, valid boolean")
    assert [r["seq"] for r in logs.valid_prefix(f).orderBy("seq").collect()] == [0, 1, 2]
    assert rows(logs.torn(f)) == [(1, 3, 2, 20)]
    at = logs.offsets(f)
    assert logs.commit_prefix(at, 25).count() == 2 and logs.read_from(at, 30).count() == 2 and logs.truncate_to(at, 20).count() == 2
    assert rows(logs.boundary(at, F.lit(25))) == [(1, False)] and rows(logs.boundary(at, F.lit(50))) == [(1, True)]
    steps = spark.createDataFrame([(1, i, v, p) for i, (v, p) in enumerate([(1, 0), (2, 1), (2, 999), (8, 2)])], "execution_id long, seq long, version long, parent long")
    assert logs.freeze_at_gaps(steps, ["execution_id"]).count() == 2
    assert rows(logs.chain_breaks(steps, ["execution_id"])) == [(1, 2, 2, 2)]


def test_lineage(spark):
    f = spark.createDataFrame([(1, [], "running"), (1, [2], "failed"), (1, [2, 0], "running"), (1, [3, 1], "running")], "execution_id long, path array<int>, status string")
    assert [r["ancestor"] for r in lineage.ancestors(f.where("size(path) = 2 and path[0] = 2")).orderBy("distance").collect()] == [[2], []]
    assert lineage.subtree(f, [2]).count() == 2 and lineage.live(f).count() == 3
    assert [r["path"] for r in lineage.orphans(f).collect()] == [[3, 1]]


def test_sweep_gives_no_breach_twice(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    e = spark.createDataFrame([(1, 1, t(0), "signup"), (1, 2, t(3), "purchase"), (2, 3, t(1), "signup"), (2, 4, t(20), "purchase")], "user_id long, event_id long, ts timestamp_ntz, event_type string")
    x = contracts.expectations(contracts.instances(e, "signup"), e, "purchase", "12 hours")
    due = contracts.sweep(x, F.lit(t(22)))
    assert [r["user_id"] for r in due.collect()] == [2]
    assert contracts.sweep(x, F.lit(t(22)), due.select("opened_by")).count() == 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(values):
    return sorted(str([None if x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in row]) for row in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    told = duck.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(told.columns)
    assert sorted(found.columns) == columns
    clean = lambda x: x[columns].astype(object).where(x[columns].notna(), float("nan")).values.tolist()
    assert comparable(clean(found)) == comparable(clean(told))


def test_streamed_fold_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    found = ledger_stream.run_to_end(ledger_stream.running_totals(ledger_stream.first_by_key(stream, "event_id", "ts", "1 hour"), "user_id"), str(tmp_path / "check"), "complete", "totals")
    batch = events.groupBy("user_id").agg(F.sum(F.round("value").cast("long")).alias("total"), F.count("*").alias("n"))
    assert rows(logs.agreement(found, batch)) == []


@pytest.mark.parametrize("how", [{}, {"slide": "2 hours"}, {"gap": "5 hours"}])
def test_streamed_windows(spark, tmp_path, how):
    """Windows that the watermark has passed go out once, and are those of the batch; late events count nowhere."""
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    files = [[(1, 1, at(0), 2.0), (2, 1, at(5), 3.0), (3, 2, at(1), 4.0)], [(4, 1, at(7), 5.0), (5, 2, at(20), 6.0)], [(9, 2, at(20.5), 1.0)], [(6, 1, at(2), 99.0), (7, 1, at(40), 7.0)], [(8, 2, at(80), 8.0)]]
    schema = "event_id long, user_id long, ts timestamp, value double"
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    totals = lambda df: ledger_stream.windowed_totals(df, "user_id", "ts", "6 hours", "1 hour", **how)
    found = ledger_stream.run_to_end(totals(stream), str(tmp_path / "check"), "append", f"windows{len(str(how))}")
    in_time = spark.createDataFrame([r for part in files for r in part if r[0] != 6], schema)
    due = totals(in_time).where(F.col("ends") <= F.lit(at(79)))
    assert found.count() > 3 and rows(logs.agreement(found, due)) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
