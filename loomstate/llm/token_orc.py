"""Token ids as ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of doc_id and sorted, so that files, stripes and row groups hold ascending ids and
their statistics prune a look-up; `start` counts within a file, and a reader adds what the files before it hold,
which it learns from the n_tokens column alone. Stripes are small enough that several tasks read one file. There are as
many files as shuffle partitions, or more if the table's size, as Spark estimates it, asks for them.

Defined results: a null text is empty and has only the end id; null ids come first; rows with the same id keep no
certain order among themselves, but lie together; a text of any length is one row; other columns aren't read; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column_of, ints_as_lists, read_table, scratch_path, text_column, texts_of
from .encoding import encoder, vocabulary

END_ID = 2
STRIPE_BYTES, INDEX_ROWS, BLOOM_FPP = 8 << 20, 1000, 0.01
#: Bytes of the table for a file, about, and files at most.
FILE_BYTES, MOST_FILES = 128 << 20, 100_000
FILE_SCHEMA = "part int, doc_id long, start long, n_tokens long, ids array<int>"


def encode_rows(parts: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, end, part, start = encoder(path, False), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
    for batch in parts:
        ids = [encode(x.decode("utf-8", "replace")) + end for x in texts_of(batch, "text")]
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        starts = start + np.cumsum(sizes) - sizes
        start += int(sizes.sum())
        columns = [pa.array(np.full(len(ids), part, np.int32)), column_of(batch, "doc_id"), pa.array(starts), pa.array(sizes), ints_as_lists(ids)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "n_tokens", "ids"])


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, files: int | None = None) -> None:
    """Writes documents (doc_id, text) as ORC files under path, in ascending doc_id order."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // FILE_BYTES, MOST_FILES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    dealt = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    encoded = dealt.mapInArrow(partial(encode_rows, path=tokenizer, end_id=end_id), FILE_SCHEMA)
    options = {"orc.stripe.size": STRIPE_BYTES, "orc.create.index": "true", "orc.row.index.stride": INDEX_ROWS, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": BLOOM_FPP}
    encoded.write.options(**options).orc(path)


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids. What is broadcast has one row, two numbers, for each file."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    before = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = rows.groupBy("part").agg(F.sum("n_tokens").alias("held")).select("part", before.alias("base"))
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of those documents; stripe statistics, row indexes and Bloom filters leave out the rest."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def digest_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        ids = column_of(batch, "ids")
        ends, values = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([column_of(batch, c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-orc")
    write_token_orc(read_table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return read_token_orc(spark, path).mapInArrow(digest_rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
