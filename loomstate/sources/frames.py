"""Framed binary logs: frames of length, checksum and payload, their encoding and the decoding of what is undamaged.

A frame is its payload's length and its FNV-1a checksum of 32 bits, both little-endian and unsigned, then the payload.
A log may stop anywhere, and any byte of it may be damaged: decoding gives its longest valid prefix.

As a table a log has a row for each block of whole frames, with the block's number, the ordinal of its first frame and the
offset where it begins, so that tasks read one log side by side. Writing goes through a log in order, a batch at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

HEADER = 8
#: A block of a log ends behind this many frames or bytes.
BLOCK_FRAMES, BLOCK_BYTES = 4096, 4 << 20
#: Fixed values of the checksum.
FNV_BASIS, FNV_PRIME, MODULUS = 2166136261, 16777619, 2**32


def fnv1a32(payload: Column) -> Column:
    """The checksum as a long. A hash below 2^32 times the prime stays within 63 bits, so it needs no wrapping and no Python."""
    at = F.when(F.octet_length(payload) > 0, F.sequence(F.lit(1), F.octet_length(payload))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.hex(F.substring(payload, i, F.lit(1))), 16, 10).cast("long")
    return F.aggregate(at, F.lit(FNV_BASIS).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * FNV_PRIME) % MODULUS)


def little_endian(value: Column) -> Column:
    """A long below 2^32 as four bytes."""
    big = F.lpad(F.hex(value), 8, "0")
    return F.unhex(F.concat(*(F.substring(big, at, 2) for at in (7, 5, 3, 1))))


def frame(payload: Column) -> Column:
    """The bytes of a payload's frame; null counts as empty."""
    p = F.coalesce(payload.cast("binary"), F.lit(b""))
    return F.concat(little_endian(F.octet_length(p).cast("long")), little_endian(fnv1a32(p)), p)


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The checksums of many stretches of bytes, side by side: a step for each byte of the longest."""
    order = np.argsort(-sizes, kind="stable")
    first, size = starts[order], sizes[order]
    found = np.full(len(sizes), FNV_BASIS, np.uint32)
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for k, n in enumerate(active.tolist()):
        found[:n] = (found[:n] ^ data[first[:n] + k]) * np.uint32(FNV_PRIME)
    out = np.empty_like(found)
    out[order] = found
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A binary column's bytes, and where each row's begin and how many they are; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends[:-1], np.diff(ends)


def _write(batches: Iterator[pa.RecordBatch], schema: pa.Schema, frames: int, most: int) -> Iterator[pa.RecordBatch]:
    """Payloads by log and in order: blocks of their frames."""
    key, held, count, size, block, first, base, began = None, [], 0, 0, 0, 0, 0, False

    def done() -> tuple:
        return key, block, first, base, b"".join(held)

    for batch in batches:
        rows = []
        data, starts, sizes = _flat(batch.column(1))
        sums, raw = checksums(data, starts, sizes), data.tobytes()
        for by, at, n, check in zip(batch.column(0).to_pylist(), starts.tolist(), sizes.tolist(), sums.tolist(), strict=True):
            if began and (by != key or count >= frames or size >= most):
                rows.append(done())
                block, first, base = (block + 1, first + count, base + size) if by == key else (0, 0, 0)
                held, count, size = [], 0, 0
            key, began = by, True
            held += [struct.pack("<II", n, check), raw[at : at + n]]
            count, size = count + 1, size + HEADER + n
        yield _batch(rows, schema)
    if began:
        yield _batch([done()], schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schemas(logs: DataFrame, by: str, fields: list[tuple]) -> tuple[StructType, pa.Schema]:
    """Of rows of a log: its key, then those fields."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = StructType([logs.schema[by], *(StructField(n, t()) for n, t in fields)])
    return spark, to_arrow_schema(spark)


def write_logs(records: DataFrame, by: str, seq: str, payload: str, frames: int = BLOCK_FRAMES, most: int = BLOCK_BYTES) -> DataFrame:
    """by, block, first, base, log: the frames of each log in the order of seq, in blocks that end behind so many frames or bytes."""
    schema, arrow = _schemas(records, by, [("block", LongType), ("first", LongType), ("base", LongType), ("log", BinaryType)])
    rows = records.select(by, F.col(payload).cast("binary").alias("_p"), F.col(seq).alias("_s"))
    ordered = rows.repartition(by).sortWithinPartitions(by, "_s").select(by, "_p")
    return ordered.mapInArrow(partial(_write, schema=arrow, frames=frames, most=most), schema)


def checksum(data: bytes) -> int:
    return int(checksums(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([len(data)]))[0])


def scan(log: bytes, verify: bool = True) -> Iterator[tuple[int, int]]:
    """(offset, length of the payload) of each frame, up to the first that is cut short or, with verify, damaged."""
    at = 0
    while at + HEADER <= len(log):
        length, expected = struct.unpack_from("<II", log, at)
        end = at + HEADER + length
        if end > len(log) or (verify and checksum(log[at + HEADER : end]) != expected):
            return
        yield at, end - at - HEADER
        at = end


def _read(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The valid frames at the head of each block; a block that has more than these ends in a row without payload."""
    for batch in batches:
        rows = []
        for key, block, first, base, log in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            log = log or b""
            data, places = np.frombuffer(log, np.uint8), np.array(list(scan(log, False)), np.int64).reshape(-1, 2)
            told = data[places[:, :1] + np.arange(4, 8)].astype(np.uint32) @ (np.uint32(1) << np.arange(0, 32, 8, dtype=np.uint32))
            bad = np.flatnonzero(told != checksums(data, places[:, 0] + HEADER, places[:, 1]))
            good = places[: bad[0]] if len(bad) else places
            end = 0
            for n, (at, size) in enumerate(good.tolist()):
                end = at + HEADER + size
                rows.append((key, first + n, base + at, base + end, log[at + HEADER : end], block))
            if end < len(log):
                rows.append((key, first + len(good), base + end, base + len(log), None, block))
        yield _batch(rows, schema)


def read_logs(logs: DataFrame, by: str) -> DataFrame:
    """by, ordinal, offset, end_pos, payload of the frames of each log's longest valid prefix.

    logs: by, block, first, base, log; without the first three a log is one block. Blocks are cut and their checksums compared
    in Arrow batches; frames of blocks behind a log's first bad or missing one go. A null log has no frames.
    """
    whole = {"block": 0, "first": 0, "base": 0}
    if not set(whole) <= set(logs.columns):
        logs = logs.withColumns({c: F.lit(v).cast("long") for c, v in whole.items()})
    schema, arrow = _schemas(logs, by, [("ordinal", LongType), ("offset", LongType), ("end_pos", LongType), ("payload", BinaryType), ("_block", LongType)])
    frames = logs.select(by, "block", "first", "base", "log").mapInArrow(partial(_read, schema=arrow), schema)
    order = Window.partitionBy(by).orderBy("block")
    slim = logs.select(by, "block", "base", F.coalesce(F.octet_length("log"), F.lit(0)).alias("size"))
    missing = slim.withColumn("_due", F.lag(F.col("base") + F.col("size"), 1, 0).over(order)).where("base <> _due").select(by, (F.col("block") - 1).alias("_block"))
    bad = frames.where("payload is null").select(by, "_block").union(missing).groupBy(by).agg(F.min("_block").alias("_bad"))
    kept = frames.join(bad, by, "left").where("payload is not null and (_bad is null or _block <= _bad)")
    return kept.select(by, "ordinal", "offset", "end_pos", "payload")


def torn_bytes(logs: DataFrame, frames: DataFrame, by: str) -> DataFrame:
    """by, kept_bytes, torn_bytes: what the frames read from each log hold, and what is left behind them."""
    logs = logs.groupBy(by).agg(F.sum(F.coalesce(F.octet_length("log"), F.lit(0))).alias("_all"))
    ends = frames.groupBy(by).agg(F.max("end_pos").alias("_end"))
    kept = F.coalesce("_end", F.lit(0)).cast("long")
    return logs.join(ends, by, "left").select(by, kept.alias("kept_bytes"), (F.col("_all") - kept).cast("long").alias("torn_bytes"))


def damage(logs: DataFrame, by: str, masks: tuple[int, ...] = (0x01, 0x80, 0xFF)) -> DataFrame:
    """by, how, at, log: each log cut off at every byte, and with every byte flipped by each mask. For tests of small logs."""
    size = F.octet_length("log")
    cuts = logs.select(by, F.lit("cut").alias("how"), F.explode(F.sequence(F.lit(0), size)).alias("at"), "log").withColumn("log", F.expr("substring(log, 1, at)"))
    places = logs.where(size > 0).select(by, F.explode(F.sequence(F.lit(0), size - 1)).alias("at"), "log")
    byte = F.conv(F.hex(F.expr("substring(log, at + 1, 1)")), 16, 10).cast("int")
    flipped = [places.select(by, F.lit(f"flip {m}").alias("how"), "at", F.concat(F.expr("substring(log, 1, at)"), F.unhex(F.lpad(F.hex(byte.bitwiseXOR(F.lit(m))), 2, "0")), F.expr("substring(log, at + 2)")).alias("log")) for m in masks]
    for f in flipped:
        cuts = cuts.unionByName(f)
    return cuts


# Sizes of records: fixed width against variable-length integers


def varint_size(value: Column) -> Column:
    """Bytes of a non-negative long in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("long")


def zigzag(value: Column) -> Column:
    """Signed to unsigned, small magnitudes first; its bits as a long."""
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def delta_sizes(ops: DataFrame) -> DataFrame:
    """ops (kind, key, amount, and scale for compute) with raw_bytes and compact_bytes of the operation alone.

    Both have a byte for the kind. Raw: the key with four bytes of length, eight bytes for each number. Compact: a
    varint of length, zigzag varints for signed numbers; a sleep has one unsigned number and no key, an emit or a fail its
    text (key) and no number.
    """
    key, sleeps, told = F.octet_length("key").cast("long"), F.col("kind") == "sleep", F.col("kind").isin("emit", "fail")
    numbers = F.when(F.col("kind") == "compute", 2).when(told, 0).otherwise(1)
    raw = F.when(sleeps, F.lit(9)).otherwise(1 + 4 + key + 8 * numbers)
    signed = varint_size(zigzag(F.col("amount"))) + F.when(F.col("kind") == "compute", varint_size(zigzag(F.col("scale")))).otherwise(0)
    compact = F.when(sleeps, 1 + varint_size(F.col("amount"))).otherwise(1 + varint_size(key) + key + F.when(told, 0).otherwise(signed))
    return ops.withColumn("raw_bytes", raw.cast("long")).withColumn("compact_bytes", compact.cast("long"))
