"""What the operators share: reading tables, cutting lineage, folds, Arrow columns."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch_path, stored

__all__ = ["batches", "column_of", "columns_of", "fold", "give_back", "ints_as_lists", "lean", "read_table", "scratch_path", "stored", "text_column", "texts_of"]
#: Rows that one Arrow batch brings to a Python worker; with long texts the default of 10,000 is too much memory.
ARROW_ROWS = 1024
#: ASCII white space, as every word pattern of the operators has it.
SPACES = r"[\x20\x09-\x0D]+"


#: Seconds between two times that a worker gives memory back; each takes it a few milliseconds.
GIVE_BACK_S = 0.1
_given = 0.0
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def give_back(always: bool = False) -> None:
    """Gives the system what this worker has freed; else its allocators keep the most that any batch took, for all stages to come."""
    global _given
    if always or time.monotonic() - _given >= GIVE_BACK_S:
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)
        _given = time.monotonic()


def lean(rows_of: Callable) -> Callable:
    """A function over a task's Arrow batches that gives back what it has freed, after batches and at the end."""

    @wraps(rows_of)
    def rows(parts: Iterator[pa.RecordBatch], *args, **kwargs) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(parts, *args, **kwargs):
            yield batch
            del batch
            give_back()
        give_back(always=True)

    return rows


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name; Spark reads it, so any store that Spark knows will do."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, of: int = 5) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def text_column(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by their own names, whatever stands in these (a dot names no field)."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string or binary column as bytes; null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return [x or b"" for x in column.cast(pa.large_binary() if large else pa.binary()).to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ints_as_lists(chunks: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit ids of each row as an array<int> column, without a Python object per id."""
    ends = np.cumsum([0, *(len(x) // 4 for x in chunks)], dtype=np.int32)
    values = pa.array(np.frombuffer(b"".join(chunks), "<i4"))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples gathered into record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
