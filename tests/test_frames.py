"""Framed logs: round trip, damage at every byte, and sizes."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from loomstate.sources import frames


def logs_of(spark, rows):
    records = spark.createDataFrame(rows, "log_id long, seq long, payload binary")
    return frames.write_logs(records, "log_id", "seq", "payload")


def test_known_checksums(spark):
    found = spark.createDataFrame([(b"",), (b"a",), (b"foobar",)], "p binary").select(frames.fnv1a32(F.col("p"))).collect()
    assert [r[0] for r in found] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    assert frames.checksum(b"foobar") == 0xBF9CF968


def test_round_trip(spark):
    rows = [(1, 3, b"third"), (1, 1, b"first \x00\xff"), (1, 2, None), (2, 9, b"x" * 300)]
    logs = logs_of(spark, rows)
    raw = {r["log_id"]: bytes(r["log"]) for r in logs.collect()}
    assert raw[2] == struct.pack("<II", 300, frames.checksum(b"x" * 300)) + b"x" * 300
    found = [(r["log_id"], r["ordinal"], bytes(r["payload"])) for r in frames.read_logs(logs, "log_id").orderBy("log_id", "ordinal").collect()]
    assert found == [(1, 0, b"first \x00\xff"), (1, 1, b""), (1, 2, b"third"), (2, 0, b"x" * 300)]
    assert frames.read_logs(logs.where("false"), "log_id").count() == 0
    assert frames.read_logs(logs.withColumn("log", F.lit(None).cast("binary")), "log_id").count() == 0


def test_every_damage_leaves_a_prefix(spark):
    payloads = [b"alpha", b"", b"gamma-delta"]
    log = logs_of(spark, [(1, i, p) for i, p in enumerate(payloads)])
    hurt = frames.damage(log, "log_id").withColumn("case", F.concat_ws(":", "how", "at")).drop("log_id")
    read = frames.read_logs(hurt, "case").groupBy("case").agg(F.array_sort(F.collect_list(F.struct("ordinal", "payload"))).alias("ps"))
    found = {r["case"]: [bytes(p["payload"]) for p in r["ps"]] for r in read.collect()}
    ends, at = [], 0
    for p in payloads:
        at += frames.HEADER + len(p)
        ends.append(at)
    cases = [(r["case"], r["how"], r["at"], bytes(r["log"])) for r in hurt.collect()]
    assert len(cases) == at + 1 + 3 * at
    for case, how, where, raw in cases:
        whole = sum(e <= where for e in ends)
        assert found.get(case, []) == payloads[:whole], case
        assert len(list(frames.scan(raw))) == whole, case
        assert how == "cut" or len(raw) == at


@pytest.mark.parametrize("size, most", [(1, 1 << 20), (3, 1 << 20), (4096, 40), (4096, 1 << 20)])
def test_blocks(spark, size, most):
    """A log in blocks reads as one; damage in a block, or a lost block, ends it there and leaves other logs alone."""
    rng = random.Random(size)
    rows = [(log, i, bytes(rng.randrange(256) for _ in range(rng.randrange(30)))) for log in (1, 2) for i in range(20)]
    logs = frames.write_logs(spark.createDataFrame(rows, "log_id long, seq long, payload binary"), "log_id", "seq", "payload", size, most).cache()
    read = lambda df: [(r["log_id"], r["ordinal"], bytes(r["payload"])) for r in frames.read_logs(df, "log_id").orderBy("log_id", "ordinal").collect()]
    assert read(logs) == rows
    blocks = logs.where("log_id = 1").orderBy("block").collect()
    assert sum(len(b["log"]) for b in blocks) == sum(8 + len(p) for i, _, p in rows if i == 1)
    b = blocks[len(blocks) // 2]
    broken = logs.withColumn("log", F.when((F.col("log_id") == 1) & (F.col("block") == b["block"]), F.expr("substring(log, 1, octet_length(log) - 1)")).otherwise(F.col("log")))
    inside = len(list(frames.scan(bytes(b["log"]))))
    assert read(broken) == rows[: b["first"] + inside - 1] + rows[20:]
    assert read(logs.where(f"log_id = 2 or block <> {b['block']}")) == (rows[: b["first"]] + rows[20:])


def test_torn_tail(spark):
    log = logs_of(spark, [(1, 0, b"kept")])
    torn = log.withColumn("log", F.concat("log", F.lit(bytes([64, 0, 0, 0, 1, 2, 3, 4, 7, 7, 7]))))
    assert [tuple(r) for r in frames.torn_bytes(torn, frames.read_logs(torn, "log_id"), "log_id").collect()] == [(1, 12, 11)]


def test_sizes(spark):
    top = 2**63 - 1
    ops = spark.createDataFrame([("add", "k", 1, 1), ("add", "k", -65, 1), ("set", "k", top, 0), ("set", "k", -top - 1, 0), ("compute", "key", 0, -1), ("sleep", "k", 300, 1)], "kind string, key string, amount long, scale long")
    assert [(r["raw_bytes"], r["compact_bytes"]) for r in frames.delta_sizes(ops).collect()] == [(14, 4), (14, 5), (14, 13), (14, 13), (24, 7), (9, 3)]
