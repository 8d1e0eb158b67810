"""Folds of ordered operations into states, prefix states, and compaction of runs.

Operations: execution_id, seq, kind (set, add, compute, sleep, emit, fail), key, amount, and scale for computes (null for others).
A set, add or compute is a map of its key's value; an emit adds one to the key __emit__; a sleep or a fail touches nothing.

Logs are cut into parts of PART sequence numbers. A part composes to one map, so a log of any length spreads over tasks, and
only a row for each part goes through an execution's own order. Values are 64-bit; one that leaves them is an error, as in
each step of the operations themselves: prefix_states tells every such step, folds only what doesn't come back within a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.affine import EMITTED, apply_all, apply_wide, compose_if_fits, is_barrier, scale_of

#: Sequence numbers of a part that is folded by itself; no array grows beyond them, however long a log is.
PART = 4096
LOW, HIGH = -(2**63), 2**63 - 1


def affine(ops: DataFrame) -> DataFrame:
    """The operations that touch a key, with its scale and addend."""
    emit = F.col("kind") == "emit"
    own = ops if "scale" in ops.columns else ops.withColumn("scale", F.lit(None).cast("long"))
    own = own.withColumn("scale", scale_of()).where("scale is not null or kind = 'compute'")
    missing = F.raise_error(F.concat(F.lit("a compute without a scale at "), F.col("seq").cast("string"))).cast("long")
    return own.withColumns({"key": F.when(emit, EMITTED).otherwise(F.col("key")), "scale": F.coalesce("scale", missing), "addend": F.when(emit, F.lit(1)).otherwise(F.col("amount")).cast("long")})


def _part(order: str = "seq"):
    return F.floor(F.col(order) / PART)


def part_maps(maps: DataFrame, by: list[str]) -> DataFrame:
    """by, part, m (the part's map) and, only where that leaves 64 bits, ops (its maps in order)."""
    one = F.array_sort(F.collect_list(F.struct("seq", "scale", "addend")))
    held = maps.groupBy(*by, _part().alias("part")).agg(one.alias("ops")).withColumn("m", compose_if_fits(F.col("ops")))
    return held.withColumn("ops", F.when(~F.col("m.fits"), F.col("ops")))


def fold_affine(ops: DataFrame, by: list[str]) -> DataFrame:
    """The final value of each key from 0. Maps compose in parts of the sequence first, then part after part, so a long log spreads over tasks."""
    return fold_parts(part_maps(affine(ops), by), by, ["part"])


def fold_parts(parts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The value of each group from 0, its parts (as part_maps has them) taken in that order."""
    step = lambda v, p: F.when(p["ops"].isNull(), apply_wide(p["m"], v)).otherwise(apply_all(p["ops"], v))
    whole = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "m", "ops"))).alias("ps"))
    return whole.select(*by, F.aggregate("ps", F.lit(0).cast("long"), step).alias("value"))


def sums_only(ops: DataFrame) -> DataFrame:
    """affine(ops), for forms that know sets and adds (and emits) only; a compute is an error, not left out."""
    refused = F.raise_error(F.concat(F.lit("a compute has no closed form: "), F.col("seq").cast("string"))).cast("long")
    return affine(ops).withColumn("scale", F.when(F.col("kind") == "compute", refused).otherwise(F.col("scale")))


def fold_closed(ops: DataFrame, by: list[str]) -> DataFrame:
    """For logs without computes: the last set, and the sum of what is added behind it. Two aggregations, no arrays."""
    own = sums_only(ops)
    last = own.where("scale = 0").groupBy(*by).agg(F.max("seq").alias("_from"))
    live = own.join(last, by, "left").where("_from is null or seq >= _from")
    return live.groupBy(*by).agg(F.sum("addend").alias("value"))


def prefix_sums(ops: DataFrame, by: list[str]) -> DataFrame:
    """For logs without computes: the value after every operation, by running sums between sets."""
    order = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = sums_only(ops).withColumn("segment", F.count_if(F.col("scale") == 0).over(order))
    return own.withColumn("value", F.sum("addend").over(Window.partitionBy(*by, "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def inside(x: int) -> int:
    if not LOW <= x <= HIGH:
        raise OverflowError("a value leaves 64 bits")
    return x


def _lists(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _with_column(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], names=[*batch.schema.names, name])


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order, _n counting them from 1 in each group: the value before each."""
    value = 0
    for batch in batches:
        before = []
        for n, m, ops in zip(*_lists(batch, "_n", "m", "ops"), strict=True):
            value = 0 if n == 1 else value
            before.append(value)
            for o in [m] if ops is None else ops:
                value = value * o["scale"] + o["addend"]
                if ops is not None:
                    inside(value)
            inside(value)
        yield _with_column(batch, "carry", before)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Operations in order, _n counting them from 1 in each part, with the value before the part: the value after each."""
    value = 0
    for batch in batches:
        after = []
        for n, carry, scale, addend in zip(*_lists(batch, "_n", "carry", "scale", "addend"), strict=True):
            value = inside(inside((carry if n == 1 else value) * scale) + addend)
            after.append(value)
        yield _with_column(batch, "value", after)


def _mapped(rows: DataFrame, f, name: str) -> DataFrame:
    return rows.mapInArrow(f, StructType([*rows.schema, StructField(name, LongType())]))


def prefix_states(ops: DataFrame, by: list[str]) -> DataFrame:
    """The value after every operation, of any scale. Parts are walked each by itself from the value that is carried into it."""
    number = lambda keys, order: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    own = affine(ops)
    carried = _mapped(part_maps(own, by).withColumn("_n", number(by, "part")), _carry, "carry").select(*by, "part", "carry")
    rows = own.withColumn("part", _part()).join(carried, [*by, "part"]).withColumn("_n", number([*by, "part"], "seq"))
    return _mapped(rows, _walk, "value").drop("_n", "carry", "part")


def runs(ops: DataFrame, by: str = "execution_id") -> DataFrame:
    """ops with barrier and run, the sequence number that a run of adjacent operations on one key begins with; a barrier is a run of its own.

    A part tells its runs by itself, but for what its first operation continues; that follows from a row for each part.
    """
    within = Window.partitionBy(by, "_part").orderBy("seq")
    edge = F.struct(F.col("barrier"), F.col("key"))
    begins = lambda before: F.col("barrier") | before["barrier"] | (before["key"] != F.col("key"))
    own = ops.withColumns({"barrier": is_barrier(), "_part": _part()}).withColumn("_before", F.lag(edge).over(within))
    own = own.withColumn("_new", F.when(begins(F.col("_before")), F.col("seq"))).withColumn("_start", F.max("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = own.groupBy(by, "_part").agg(F.min("seq").alias("_first"), F.min_by(edge, "seq").alias("_head"), F.max_by(edge, "seq").alias("_tail"), F.max("_new").alias("_last"))
    order = Window.partitionBy(by).orderBy("_part")
    parts = parts.withColumn("_prior", F.lag("_tail").over(order)).select("*", "_head.barrier", "_head.key")
    parts = parts.withColumn("_own", F.when(F.col("_prior").isNull() | begins(F.col("_prior")), F.col("_first")))
    opened = F.last(F.coalesce("_last", "_own"), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(by, "_part", F.coalesce("_own", opened).alias("_open"))
    return own.join(parts, [by, "_part"]).withColumn("run", F.coalesce("_start", "_open")).select(*ops.columns, "barrier", "run")


FOLDED = [StructField("seq", LongType()), StructField("kind", StringType()), StructField("key", StringType()), StructField("scale", LongType()), StructField("amount", LongType()), StructField("folded", LongType())]


class _Run:
    """A run being folded: its map so far, and the last operation folded in."""

    __slots__ = ("addend", "kept", "n", "scale")

    def __init__(self, row: tuple, scale: int, addend: int):
        self.kept, self.scale, self.addend, self.n = row, scale, addend, 1

    def extend(self, row: tuple, scale: int, addend: int) -> bool:
        both = self.scale * scale, self.addend * scale + addend
        if not all(LOW <= x <= HIGH for x in both):
            return False
        (self.scale, self.addend), self.kept, self.n = both, row, self.n + 1
        return True

    def row(self) -> tuple | None:
        if self.scale == 1 and self.addend == 0:
            return None
        by, seq, _, key, _, _ = self.kept
        return (*self.kept, 1) if self.n == 1 else (by, seq, "compute", key, self.scale, self.addend, self.n)


def _fold_runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Operations run by run in order, _n counting them from 1 in each. One run at a time is held, and of it one map."""
    run: _Run | None = None
    for batch in batches:
        out: list[tuple | None] = []
        for n, barrier, *row in zip(*_lists(batch, "_n", "barrier", *schema.names[:-1]), strict=True):
            *_, map_scale, map_addend = row
            if n == 1 and run:
                out.append(run.row())
                run = None
            if barrier:
                out.append((*row, 1))
            elif run is None:
                run = _Run(row, map_scale, map_addend)
            elif not run.extend(row, map_scale, map_addend):
                out += [run.row(), (*row, 1)]
                run = None
        yield _rows(out, schema)
    if run:
        yield _rows([run.row()], schema)


def _rows(rows: list[tuple | None], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*(r for r in rows if r), strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def coalesce_runs(ops: DataFrame, by: str = "execution_id") -> DataFrame:
    """A run of two or more becomes one compute with the last one's sequence; runs that change nothing go; barriers and single
    operations stay. Operations come out as they went in, with the scale of their map (1 for a barrier), so that they can be folded again;
    folded counts what one stands for.

    An operation that would take the map out of 64 bits ends the run so far, goes out as it is, and the next begins anew. What
    is folded may hide that a value would have left 64 bits in between. One run goes through one task, a batch at a time.
    """
    own = ops if "scale" in ops.columns else ops.withColumn("scale", F.lit(None).cast("long"))
    amount = F.col("amount").cast("long")
    number, scale = F.row_number().over(Window.partitionBy(by, "run").orderBy("seq")), F.when(F.col("barrier"), F.lit(1)).otherwise(scale_of()).cast("long")
    marked = runs(own, by).withColumns({"_n": number, "scale": scale, "amount": amount})
    schema = StructType([ops.schema[by], *FOLDED])
    arrow = pa.schema([(by, pa.string() if isinstance(ops.schema[by].dataType, StringType) else pa.int64()), *((f.name, pa.int64() if isinstance(f.dataType, LongType) else pa.string()) for f in FOLDED)])
    names = ["_n", "barrier", *arrow.names[:-1]]
    return marked.select(*names).mapInArrow(partial(_fold_runs, schema=arrow), schema)
