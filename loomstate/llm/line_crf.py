"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are shares of byte classes, word and repetition measures of the
line and of both its neighbours; transition weights tie neighbouring labels. Training lines bear their document's
label. Forward and backward recursions give each line's marginal, and a document's score is the mean of its lines'
marginals for good, weighted by their bytes; a line is bad if its marginal for good is below one half.

The model is fitted on a bounded sample of labelled documents (SAMPLE_DOCS of at most SAMPLE_BYTES each, those whose
hashed ids are smallest); everything else covers all documents and whole texts.

Defined results: a null or empty text is one empty line and gets a score; null identifiers are scored and are never
labelled; contradicting labels of a document both count; repeated rows are scored each for itself, and equal texts alike;
a line ties at one half for good; without labels every score is 0.5; texts of any length count whole, and other columns,
whatever their names, stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import column_of, columns_of, fold, lean, read_table, text_column, texts_of

SAMPLE_DOCS, SAMPLE_BYTES = 3000, 65536
STEPS, RATE, RIDGE = 250, 0.15, 1e-4
#: Byte classes: lower, upper, digit, marks that seldom stand in prose, !, |, stops, other ASCII marks, beyond ASCII.
CLASSES = np.zeros((256, 9), np.float32)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b"#*$%&<>{}[]\\^~=_@/+", b"!", b"|", b".,;:?'\"()-", b"`", range(128, 256))):
    CLASSES[list(_bytes), _k] = 1
SCALE = np.array([1, 3, 3, 10, 10, 10, 5, 10, 2], np.float32)
OWN = 17
WIDTH = 3 * OWN


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, and the lines' weights (bytes and one)."""
    lines = text.split(b"\n")
    sizes = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    seen, rows = set(), []
    for line in lines:
        words = line.split()
        n = len(words)
        rows.append((n, sum(map(eq, words, words[1:])), n - len(set(words)), line in seen and n > 0))
        if n:
            seen.add(line)
    counts = np.add.reduceat(CLASSES[np.frombuffer(text + b"\n", np.uint8)], starts, axis=0)
    n, again, repeated, dup = np.array(rows, np.float32).T
    out = np.zeros((len(lines), OWN), np.float32)
    out[:, :9] = np.minimum(counts / np.maximum(sizes, 1)[:, None] * SCALE, 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    out[:, 9] = counts[:, 1] / letters
    out[:, 10] = np.minimum(sizes / np.maximum(n, 1) / 20, 1)
    out[:, 11] = again / np.maximum(n - 1, 1)
    out[:, 12] = repeated / np.maximum(n, 1)
    out[:, 13] = dup
    out[:, 14] = np.minimum(np.log1p(sizes) / 8, 1)
    out[:, 15] = n <= 1
    out[:, 16] = 1
    before, after = np.zeros_like(out), np.zeros_like(out)
    before[1:], after[:-1] = out[:-1], out[1:]
    return np.hstack([out, before, after]), sizes + 1


class Chains:
    """Sequences side by side, the longest first, so that each step of a recursion is one array operation."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        size = lengths[self.order]
        first = np.cumsum(lengths) - lengths
        self.active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        self.at = [first[self.order[:k]] + t for t, k in enumerate(self.active)]

    def marginals(self, odds: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of good, and the expected transitions of each line from the one before it (lines x 2 x 2)."""
        psi = np.ones((len(odds), 2))
        psi[:, 1] = np.exp(np.clip(odds, -30, 30))
        step, alpha, beta, scale, pairs = np.exp(moves), np.empty_like(psi), np.ones_like(psi), np.empty(len(psi)), np.zeros((len(psi), 2, 2))
        for t, at in enumerate(self.at):
            u = psi[at] if t == 0 else (alpha[self.at[t - 1][: len(at)]] @ step) * psi[at]
            scale[at] = u.sum(axis=1)
            alpha[at] = u / scale[at][:, None]
        for t in range(len(self.at) - 1, 0, -1):
            at, before = self.at[t], self.at[t - 1][: len(self.at[t])]
            ahead = psi[at] * beta[at] / scale[at][:, None]
            pairs[at] = alpha[before][:, :, None] * step[None] * ahead[:, None, :]
            beta[before] = ahead @ step.T
        both = alpha * beta
        return both[:, 1] / both.sum(axis=1), pairs


def seen_moves(y: np.ndarray, share: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each label follows each, by weight; lines of a document bear the same."""
    later, seen = np.ones(len(y), bool), np.zeros((2, 2))
    later[np.cumsum(lengths) - lengths] = False
    for k in (0, 1):
        seen[k, k] = share[later & (y == k)].sum()
    return seen


def gradient(chains: Chains, x: np.ndarray, y: np.ndarray, share: np.ndarray, seen: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Of the conditional log-likelihood, ridged, by weights and then moves."""
    good, pairs = chains.marginals(x @ weights, moves)
    return np.concatenate([x.T @ ((y - good) * share) - RIDGE * weights, (seen - (pairs * share[:, None, None]).sum(axis=0) - RIDGE * moves).ravel()])


def fit(texts: list[bytes], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores, by gradient steps on the conditional likelihood; each document weighs the same."""
    weights, moves = np.zeros(WIDTH), np.zeros((2, 2))
    if not texts:
        return weights, moves
    found = [line_features(x)[0] for x in texts]
    lengths = np.array([len(x) for x in found])
    x, y = np.vstack(found).astype(np.float64), np.repeat(np.array(labels, np.float64), lengths)
    share = np.repeat(1 / lengths / len(lengths), lengths)
    chains, seen = Chains(lengths), seen_moves(y, share, lengths)
    state = [np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)]
    for k in range(1, STEPS + 1):
        slope = gradient(chains, x, y, share, seen, weights, moves)
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.99 * state[1] + 0.01 * slope**2
        move = RATE * state[0] / (1 - 0.9**k) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-9)
        weights, moves = weights + move[:WIDTH], moves + move[WIDTH:].reshape(2, 2)
    return weights, moves


def line_marginals(texts: list[bytes], model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's marginal for good and its weight, line after line, and the lines of each text."""
    found = [line_features(x) for x in texts]
    lengths = np.array([len(w) for _, w in found])
    good, _ = Chains(lengths).marginals(np.concatenate([x @ model[0] for x, _ in found]), model[1])
    return good, np.concatenate([w for _, w in found]).astype(np.float64), lengths


def score_texts(texts: list[bytes], model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, lines, and bad lines."""
    good, weight, lengths = line_marginals(texts, model)
    first = np.cumsum(lengths) - lengths
    scores = np.clip(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 0, 1)
    return scores, lengths, np.add.reduceat((good < 0.5).astype(np.int64), first)


@lean
def score_rows(parts: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        texts = texts_of(batch, "_text")
        for at in range(0, len(texts), 256):
            part = batch.slice(at, 256)
            found = score_texts(texts[at : at + 256], model)
            yield pa.RecordBatch.from_arrays([column_of(part, "_row"), *map(pa.array, found)], names=["_row", "score", "n_lines", "bad_lines"])


@lean
def line_rows(parts: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        texts = texts_of(batch, "_text")
        for at in range(0, len(texts), 256):
            good, _, lengths = line_marginals(texts[at : at + 256], model)
            rows = column_of(batch, "_row").take(pa.array(at + np.repeat(np.arange(len(lengths)), lengths)))
            line = np.arange(len(good)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays([rows, pa.array(line, pa.int32()), pa.array(good), pa.array(good >= 0.5)], names=["_row", "line", "marginal", "good"])


def trained(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Learns from labelled documents whose fold isn't 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().where(fold("doc_id") != 0)
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE_DOCS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = rows.join(F.broadcast(picked), "doc_id").orderBy("doc_id", "quality").collect()  # SAMPLE_DOCS rows
    return fit([r["text"].encode() for r in rows], [int(r["quality"] > 0) for r in rows])


def mapped(docs: DataFrame, labels: DataFrame, columns: list, rows_of, more: list[StructField]) -> DataFrame:
    model = trained(docs.sparkSession, docs, labels)
    rows = docs.select(F.struct(*columns).alias("_row"), text_column().alias("_text"))
    return rows.mapInArrow(partial(rows_of, model=model), StructType([rows.schema["_row"], *more])).select("_row.*", *(f.name for f in more))


def scored(docs: DataFrame, labels: DataFrame, columns: list) -> DataFrame:
    """Those columns of docs, score, n_lines and bad_lines."""
    return mapped(docs, labels, columns, score_rows, [StructField("score", DoubleType()), StructField("n_lines", LongType()), StructField("bad_lines", LongType())])


def line_labels(docs: DataFrame, labels: DataFrame, columns: list) -> DataFrame:
    """A row for each line: those columns of docs, line (from 0), its marginal for good, and whether it is good."""
    return mapped(docs, labels, columns, line_rows, [StructField("line", IntegerType()), StructField("marginal", DoubleType()), StructField("good", BooleanType())])


THRESHOLD = 0.3


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't rejected, with their columns."""
    wrapped = docs.select("doc_id", "text", F.struct(*columns_of(docs)).alias("_all"))
    return scored(wrapped, labels, ["_all"]).where(F.col("score") >= threshold).select("_all.*")


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines", "bad_lines")
