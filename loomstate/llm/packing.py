"""Packing by shortest-pack-first over the length histogram.

A document's ids are cut into pieces of at most `room` ids. The histogram of piece lengths, bounded by room, is
packed on the driver: lengths from the longest to the shortest, each into the pack that is shortest so far if it
fits, splitting a packing pattern's count where only a part of its copies takes one. The patterns become segments
of ranks for each length; a piece finds its segment by its rank among the pieces of its length. Ranks are counted
in parts of each length, as many as its count asks for, so that the commonest length is spread over tasks of PART_ROWS pieces.

Defined results: a null or empty text has only its end id; repeated rows, and rows with null or equal identifiers, are packed
each for itself (those equal in identifier, text and place may change places); long texts have many pieces; other columns aren't
read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column_of, lean, read_table, stored, text_column, texts_of
from .encoding import encoder, vocabulary

ROOM, END_ID = 1024, 0
#: Pieces of one length that are ranked together, about, and the share of all pieces that these are at most.
PART_ROWS, PART_SHARE = 100_000, 1024
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lean
def cut_rows(parts: Iterator[pa.RecordBatch], path: str, room: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(path, True), np.array([end_id], "<u4").tobytes()
    for batch in parts:
        rows: list[tuple] = []
        for doc_id, text in zip(column_of(batch, "doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
            ids = encode(text.decode("utf-8", "replace")) + end
            for at in range(0, len(ids), 4 * room):
                piece = ids[at : at + 4 * room]
                rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, *([piece] if with_ids else [])))
        kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.binary())] * with_ids
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; with_ids: with their ids, little-endian 32-bit."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return rows.mapInArrow(partial(cut_rows, path=tokenizer, room=room, end_id=end_id, with_ids=with_ids), PIECES + (", ids binary" if with_ids else ""))


def shortest_pack_first(histogram: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of placement) and how many packs have each."""
    packs: dict[int, list[list]] = {}  # free room -> [lengths, count]
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            free = max((g for g in packs if packs[g]), default=0)
            if free < length:  # new packs, each of which is the shortest until it is full
                each = room // length
                for copies, count in ((each, left // each), (left % each, 1)):
                    if copies and count:
                        packs.setdefault(room - copies * length, []).append([(length,) * copies, count])
                break
            lengths, count = packs[free].pop()
            used = min(count, left)
            if used < count:
                packs[free].append([lengths, count - used])
            packs.setdefault(free - length, []).append([(*lengths, length), used])
            left -= used
    return [(tuple(p), n) for g in sorted(packs) for p, n in packs[g]]


def segments(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length and first rank), the ranks' start, the first pack and the offset of each segment."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            low = used.get(length, 0)
            rows.append(((length << 44) + low, low, first, offset))
            used[length] = low + count
            offset += length
        first += count
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4


@lean
def assign_rows(parts: Iterator[pa.RecordBatch], plan, with_ids: bool) -> Iterator[pa.RecordBatch]:
    first, before, (keys, lows, firsts, offsets) = plan.value
    for batch in parts:
        length, part, rank = (column_of(batch, c).to_numpy().astype(np.int64) for c in ("length", "_part", "_rank"))
        rank = rank + before[first[length] + part]
        at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
        columns = [column_of(batch, "doc_id"), column_of(batch, "start"), pa.array(length), *(column_of(batch, c) for c in ("ids_crc32", "doc_tokens"))]
        columns += [pa.array(firsts[at] + rank - lows[at]), pa.array(offsets[at])] + [column_of(batch, "ids")] * with_ids
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKED.split(", ")] + ["ids"] * with_ids)


def parts_of(histogram: np.ndarray, rows: int) -> np.ndarray:
    """In how many parts the pieces of each length are ranked."""
    rows = max(1, min(rows, int(histogram.sum()) // PART_SHARE))
    return np.maximum(1, -(-histogram // rows))


def assign(cut: DataFrame, room: int = ROOM, part_rows: int = PART_ROWS) -> DataFrame:
    """Each piece's sequence and offset, and its ids if cut has them. cut is read three times, so it should be stored.

    To the driver come room counts, then a count for each part: one for every length, every part_rows pieces, and PART_SHARE more, at most.
    """
    with_ids = "ids" in cut.columns
    histogram = np.zeros(room + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():
        histogram[length] = n
    many = parts_of(histogram, part_rows)
    first = np.cumsum(many) - many
    key = ["doc_id", "start", "ids_crc32"]
    dealt = cut.withColumn("_part", F.pmod(F.xxhash64(*key), F.element_at(F.lit(many.tolist()), F.col("length") + 1)).cast("int"))
    counts = np.zeros(int(many.sum()), np.int64)
    for length, part, n in dealt.groupBy("length", "_part").count().collect():
        counts[first[length] + part] = n
    before = np.cumsum(counts) - counts
    before -= np.repeat(before[first], many)
    patterns = shortest_pack_first({k: int(n) for k, n in enumerate(histogram)}, room)
    plan = cut.sparkSession.sparkContext.broadcast((first, before, segments(patterns)))
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*key)) - 1
    return dealt.withColumn("_rank", rank).mapInArrow(partial(assign_rows, plan=plan, with_ids=with_ids), PACKED + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    return assign(stored(pieces(docs, tokenizer, room, end_id), "pieces"), room)


def sequences(docs: DataFrame, tokenizer: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary, at most room of them), doc_ids, starts. Pieces carry their ids
    with them, so that rows with null or equal identifiers lose and gain nothing."""
    packed = assign(stored(pieces(docs, tokenizer, room, end_id, with_ids=True), "pieces"), room)
    inside = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids"))).alias("p"))
    return inside.select("sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
