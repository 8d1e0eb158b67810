"""Language-model scores by the likelihood of a subword lattice.

The pieces of an existing vocabulary span a lattice over each word: every way to cut the word into pieces is a path,
and a word's probability is the sum over all paths of the product of its pieces' probabilities, by a forward
recursion in log space. The pieces' weights begin with the vocabulary's own scores and are then re-estimated on all
training documents by expectation maximisation over the lattice (forward and backward), smoothed; one more piece
ends a document. Characters that no piece has go by byte pieces, so every text has a probability. A text's score is
the sum of its words' and its end's.

Words are counted over all training documents. Documents are dealt by their hashed ids and texts into blocks of about
BLOCK_BYTES, so that there are more blocks, not larger ones, in a larger corpus; a block's distinct words meet their corpus-wide counts and lattice scores by a join on the word, and come back to the block as
a look-up table, so no table of all words is ever broadcast or collected. The driver sees a weight for each piece only.

Defined results: a null or empty text is its end alone; a null identifier counts as empty text in the fold; repeated rows are
scored, and counted, each for itself (rows equal in identifier and text share a block); without training documents N and V are 0,
each token's base is log10(0.5 / 0.5) = 0, and pieces keep their first weights; texts count whole, a long word by as many steps
as it has characters; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_of, fold, read_table, stored, text_column, texts_of
from .encoding import vocabulary

#: Rounds of re-estimation; the count that each piece has besides; entries of a counting table before it is passed on.
ROUNDS, PSEUDO, COUNTED = 2, 0.1, 1_000_000
#: Bytes of words that go through the lattice side by side (a longer word goes alone); bytes of a block's texts, about.
PART_BYTES, BLOCK_BYTES = 100_000, 16 << 20
SPACE = "▁"


@lru_cache(maxsize=2)
def load_pieces(path: str) -> tuple[list[str], list[float], dict[str, int], list[int]]:
    """Pieces and their scores, pieces by text (None where a text only begins longer ones), and byte pieces by byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    scores = [model.get_score(i) for i in range(len(pieces))]
    table: dict[str, int | None] = {}
    for i, piece in enumerate(pieces):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            for k in range(1, len(piece)):
                table.setdefault(piece[:k])
            table[piece] = i
    return pieces, scores, table, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def first_weights(path: str) -> np.ndarray:
    """Natural log weights of all pieces and, last, of the end: the vocabulary's scores are ranks, taken by Zipf's law."""
    scores = -np.array(load_pieces(path)[1])
    w = np.append(1 / (scores + 100), 0.01 / 100)
    return np.log(w / w.sum())


@lru_cache(maxsize=2)
def load_trie(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces' trie: sorted keys (state and character), the state that each leads to, and the piece that ends in each state or -1."""
    table = load_pieces(path)[2]
    state = {text: k for k, text in enumerate(["", *table])}
    keys = np.array([state[t[:-1]] << 21 | ord(t[-1]) for t in table], np.int64)
    order = np.argsort(keys)
    return keys[order], np.arange(1, len(state))[order], np.array([-1, *(-1 if i is None else i for i in table.values())], np.int32)


class Lattice:
    """Forward and backward recursions over the segmentations of many words side by side. logs: natural log weights by piece.

    The longest words come first, and a position's number grows with its level (how many characters are before it), so
    that all words take a level in one array operation. Row L - 1 of a grid has the pieces of L characters by their end.
    """

    def __init__(self, path: str, logs: np.ndarray):
        self.bytes, self.logs = load_pieces(path)[3], np.asarray(logs)
        self.keys, self.next, self.piece = load_trie(path)

    def spans(self, words: list[bytes]) -> tuple:
        """order of the words, active words by level, first position by level, grid of symbols, symbols' weights, bytes of further symbols."""
        texts = [SPACE + w.decode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        sizes, n = sizes[order], int(sizes.sum())
        chars = np.frombuffer("".join([texts[k] for k in order.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1), side="right")
        first = np.cumsum(active) - active
        word = np.repeat(np.arange(len(sizes)), sizes)
        begins = np.cumsum(sizes) - sizes
        level, rows = np.arange(n) - begins[word], []
        left, at, state = sizes[word] - level, np.arange(n), np.zeros(n, np.int64)
        while len(at):
            length = len(rows) + 1
            key = state << 21 | chars[at + length - 1]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[k] == key
            at, state = at[there], self.next[k[there]]
            row, piece = np.full(int(active.sum()), -1, np.int32), self.piece[state]
            ends = at[piece >= 0]
            row[first[level[ends] + length] + word[ends]] = piece[piece >= 0]
            rows.append(row)
            more = left[at] > length
            at, state = at[more], state[more]
        # a character without a piece of its own is one symbol, of its bytes
        to = first[level + 1] + word
        bare = rows[0][to] < 0
        others, which = np.unique(chars[bare], return_inverse=True)
        parts = [[self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in others.tolist()]
        rows[0][to[bare]] = len(self.logs) + which
        weights = np.concatenate([self.logs, [self.logs[x].sum() for x in parts], [-np.inf]])  # the last is -1, no piece
        return order, active, first, np.stack(rows), weights, parts

    @staticmethod
    def into(active: np.ndarray, first: np.ndarray, t: int, most: int) -> tuple[slice, np.ndarray]:
        """A level's positions, and those that each piece's length leads there from (length x word)."""
        k = int(active[t])
        return slice(int(first[t]), int(first[t]) + k), first[t - np.arange(1, min(t, most) + 1)][:, None] + np.arange(k)

    def forward(self, active: np.ndarray, first: np.ndarray, weight: np.ndarray) -> np.ndarray:
        alpha = np.zeros(weight.shape[1])
        for t in range(1, len(active)):
            to, start = self.into(active, first, t, len(weight))
            x = alpha[start] + weight[: len(start), to]
            top = x.max(axis=0)
            alpha[to] = top + np.log(np.exp(x - top).sum(axis=0))
        return alpha

    def score_all(self, words: list[bytes]) -> np.ndarray:
        """The natural logs of the words' marginal probabilities."""
        out = np.zeros(len(words))
        if words:
            order, active, first, grid, weights, _ = self.spans(words)
            alpha = self.forward(active, first, weights[grid])
            later = np.append(active[1:], 0)
            for t in np.flatnonzero(active > later).tolist():  # words that end at this level
                out[order[later[t] : active[t]]] = alpha[first[t] + later[t] : first[t] + active[t]]
        return out

    def expect_all(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """The expected number of each piece in all words, each as often as counted."""
        if not words:
            return np.zeros(len(self.logs))
        order, active, first, grid, weights, parts = self.spans(words)
        weight = weights[grid]
        alpha = self.forward(active, first, weight)
        later, share, counts = np.append(active[1:], 0), np.zeros(len(alpha)), np.asarray(counts, float)[order]
        for t in range(len(active) - 1, 0, -1):
            to, start = self.into(active, first, t, len(weight))
            share[to][later[t] :] = counts[later[t] : active[t]]  # the posterior of each position, times its word's count
            part = weight[: len(start), to]
            part[...] = np.exp(alpha[start] + part - alpha[to]) * share[to]
            share[start] += part  # all of start differ
        weight[:, : active[0]] = 0
        weight[grid < 0] = 0
        found = np.bincount(grid.ravel() % len(weights), weight.ravel(), len(weights))
        total = found[: len(self.logs)]
        for x, ids in zip(found[len(self.logs) :], parts, strict=False):
            np.add.at(total, ids, x)
        return total

    def score(self, word: bytes) -> float:
        return float(self.score_all([word])[0])

    def expect(self, word: bytes, count: float, into_counts: list[float]) -> None:
        """Adds the expected number of each piece, count times."""
        for i, x in enumerate(self.expect_all([word], np.array([count])).tolist()):
            into_counts[i] += x


COUNTS = pa.schema([("block", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])


def count_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's words and how often training documents have them."""
    held: dict[int, tuple[Counter, set]] = {}
    for batch in parts:
        for block, train, text in zip(column_of(batch, "block").to_pylist(), column_of(batch, "train").to_pylist(), texts_of(batch, "text"), strict=True):
            counts, others = held.setdefault(block, (Counter(), set()))
            (counts if train else others).update(text.lower().split())
        if sum(len(a) + len(b) for a, b in held.values()) > COUNTED:
            yield from counted(held)
            held = {}
    yield from counted(held)


def counted(held: dict) -> Iterator[pa.RecordBatch]:
    for block, (counts, others) in held.items():
        words = list(counts) + list(others - counts.keys())
        n = list(counts.values()) + [0] * (len(words) - len(counts))
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int32()), pa.array(part, pa.binary()), pa.array(n[at : at + 20_000], pa.int64())], schema=COUNTS)


def word_parts(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and their counts in parts of about PART_BYTES."""
    words, counts, size = [], [], 0
    for batch in parts:
        for word, n in zip(texts_of(batch, "word"), column_of(batch, "n").to_pylist(), strict=True):
            words.append(word)
            counts.append(n)
            size += len(word) + 1
            if size >= PART_BYTES:
                yield words, np.array(counts, np.int64)
                words, counts, size = [], [], 0
    yield words, np.array(counts, np.int64)


def expect_rows(parts: Iterator[pa.RecordBatch], path: str, logs) -> Iterator[pa.RecordBatch]:
    lattice, total = Lattice(path, logs.value), np.zeros(len(logs.value))
    for words, counts in word_parts(parts):
        total += lattice.expect_all(words, counts)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.float64())], names=["piece", "expected"])


def lattice_rows(parts: Iterator[pa.RecordBatch], path: str, logs) -> Iterator[pa.RecordBatch]:
    lattice = Lattice(path, logs.value)
    for words, counts in word_parts(parts):
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64()), pa.array(lattice.score_all(words), pa.float64())], names=["word", "n", "logp"])


def block_scorer(total: int, distinct: int, ends: int, log_end: float):
    floor = total + 0.5 * (distinct + 1)
    end_base = math.log10((ends + 0.5) / floor)

    def score(docs: pa.Table, words: pa.Table) -> pa.Table:
        index = {w: i for i, w in enumerate(words.column("word").to_pylist())}
        n, logp = words.column("n").to_numpy(), words.column("logp").to_numpy()
        base, out = np.log10((n + 0.5) / floor), []
        for text in docs.column("text"):
            found = text.as_py().encode().lower().split()
            at = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
            out.append((len(at) + 1, int((n[at] > 0).sum()) + (ends > 0), float(base[at].sum() + end_base), float((logp[at].sum() + log_end) / math.log(10))))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([docs.column("doc_id"), docs.column("train"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([total] * len(out), pa.int64())], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score", "train_tokens"])

    return score


def lm_scores(docs: DataFrame, train, pieces_path: str, blocks: int | None = None) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, score (both log10), train_tokens of each row of docs (doc_id, text); train: a boolean column."""
    spark = docs.sparkSession
    ends, size = docs.agg(F.count_if(train), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), train.alias("train"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    counts = stored(rows.select("block", "train", "text").mapInArrow(count_rows, "block int, word binary, n long"), "counts")
    words = stored(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    logs = first_weights(pieces_path)
    for _ in range(ROUNDS if total else 0):
        held = spark.sparkContext.broadcast(logs)
        expected = words.where("n > 0").mapInArrow(partial(expect_rows, path=pieces_path, logs=held), "piece int, expected double").groupBy("piece").agg(F.sum("expected"))
        weight = np.full(len(logs), PSEUDO)
        for piece, x in expected.collect():  # a row for each piece of the vocabulary at most
            weight[piece] += x
        weight[-1] += ends
        logs = np.log(weight / weight.sum())
    held = spark.sparkContext.broadcast(logs)
    scored = words.mapInArrow(partial(lattice_rows, path=pieces_path, logs=held), "word binary, n long, logp double")
    table = counts.select("block", "word").distinct().join(scored, "word").repartition(blocks, "block")
    scorer = block_scorer(total, distinct, ends, float(logs[-1]))
    out = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long"
    return rows.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(scorer, out)


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(read_table(spark, sf_dir, "documents"), fold("doc_id") != 1, vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
