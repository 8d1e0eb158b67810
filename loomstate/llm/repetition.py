"""Repetition inside a text by its suffix array over words.

Suffixes of the documents of a batch are sorted by prefix doubling, each document in an alphabet of its own; only
suffixes that still tie take part in the next round. The ranks of all rounds give the longest common prefix of
neighbours in the suffix array. A position's longest repeat is the larger of its two, which is the depth of the
innermost LCP interval that holds it; the spans of all repeats of MIN_WORDS words or more are united. A text fails if
these cover too much of it or one of them is too long.

Defined results: a null or empty text has no words and fails the base rule; rows are judged each for itself, null and
repeated identifiers too; repeats of equal length all count, and what they cover is united; a text of any length is judged
whole, its rank arrays taking eight bytes a word and doubling round; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_of, read_table, text_column, texts_of
from .near_dedup import M1, Words, mix

#: Words that a repeat must have to count; the share of words that repeats may cover; the longest repeat allowed.
MIN_WORDS, MAX_COVERED, MAX_REPEAT = 10, 0.25, 60
SYMBOLS = b"#*$%&|<>"
#: Bytes that begin no character of a word.
NOT_WORD_STARTS = bytes([*range(0x80, 0xC0), 0x20, *range(9, 14)])
#: Words that are sorted together at most, but for one longer text alone.
BATCH_WORDS = 300_000

_words = Words()


def tied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, for each in that order the place of the first equal one, and whether it has an equal."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    last = np.ones(len(keys), bool)
    last[:-1] = new[1:]
    return order, first, ~(new & last)


class SuffixArray:
    """Ranks by rounds: levels[k] is equal for two positions just when their first 2**k words are."""

    def __init__(self, letters: np.ndarray, ends: np.ndarray):
        """ends: for each position, where its document ends. Letters of different documents differ."""
        n = len(letters)
        order, first, tie = tied(letters)
        rank = np.empty(n + 1, np.int64)
        rank[order], rank[n] = first, -1
        self.levels, self.ends, live, width = [rank], ends, np.sort(order[tie]), 1
        while len(live):
            before = self.levels[-1]
            ahead = live + width
            over = ahead >= ends[live]
            second = np.where(over, -1 - live, before[np.minimum(ahead, n)])  # what ends first is unlike all others
            low = before[live]
            order = np.lexsort((second, low))
            l, s = low[order], second[order]
            group, part = np.ones(len(l), bool), np.ones(len(l), bool)
            group[1:] = l[1:] != l[:-1]
            part[1:] = group[1:] | (s[1:] != s[:-1])
            at = np.arange(len(l))
            start_group, start_part = (np.maximum.accumulate(np.where(x, at, 0)) for x in (group, part))
            rank = before.copy()
            rank[live[order]] = l + start_part - start_group
            last = np.ones(len(l), bool)
            last[:-1] = part[1:]
            self.levels.append(rank)
            live, width = np.sort(live[order][~(part & last)]), 2 * width

    def longest(self, least: int) -> np.ndarray:
        """For each position the words of the longest repeat that begins there; 0 if under `least`."""
        n = len(self.ends)
        place, found = self.levels[-1][:n], np.zeros(n, np.int64)
        k = min(int(np.log2(least)), len(self.levels) - 1)
        sa = np.empty(n, np.int64)
        sa[place] = np.arange(n)
        same = np.flatnonzero(self.levels[k][sa[1:]] == self.levels[k][sa[:-1]]) if 1 << k <= least else np.arange(n - 1)
        a, b = sa[same], sa[same + 1]
        lcp = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            i, j = a + lcp, b + lcp
            inside = (i < self.ends[a]) & (j < self.ends[b])
            equal = inside & (self.levels[k][np.minimum(i, n)] == self.levels[k][np.minimum(j, n)])
            lcp += equal.astype(np.int64) << k
        np.maximum.at(found, a, lcp)
        np.maximum.at(found, b, lcp)
        found[found < least] = 0
        return found


def covered_by(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge)[:n] > 0


def measures(texts: list[bytes]) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat, spans of each text."""
    words = [x.split() for x in texts]
    sizes = np.array([len(x) for x in words], np.int64)
    n, doc = int(sizes.sum()), np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    ends = (first + sizes)[doc]
    ids = np.fromiter((_words[w] for x in words for w in x), np.uint64, n)
    repeated = covered = np.zeros(n, bool)
    longest = np.zeros(n, np.int64)
    if n:
        array = SuffixArray(mix(ids + mix(doc.astype(np.uint64) * M1 + M1)), ends)
        longest = array.longest(MIN_WORDS)
        at = np.flatnonzero(longest)
        covered = covered_by(at, longest[at], n)
        three = np.flatnonzero(array.longest(3))
        repeated = covered_by(three, np.full(len(three), 3), n)
    count = lambda mask: np.bincount(doc[mask], minlength=len(sizes)).tolist()
    most = np.zeros(len(sizes), np.int64)
    np.maximum.at(most, doc, longest)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    spans: list[list] = [[] for _ in texts]
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        while a < b:  # a run may reach from one document into the next
            d = int(doc[a])
            end = min(b, int(first[d] + sizes[d]))
            spans[d].append({"start": a - int(first[d]), "end": end - int(first[d])})
            a = end
    out = []
    for text, size, again, over, longest_one, span in zip(texts, sizes.tolist(), count(repeated), count(covered), most.tolist(), spans, strict=True):
        lines = [x for x in text.split(b"\n") if x.strip()]
        out.append((size, len(text.translate(None, NOT_WORD_STARTS)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), again, over, longest_one, span))
    return out


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, repeat_spans array<struct<start:int,end:int>>"
KINDS = [*[pa.int64()] * 7, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]


def measure_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        texts, at = texts_of(batch, "_text"), 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to]) // 5 <= BATCH_WORDS):
                held += len(texts[to]) // 5
                to += 1
            rows = list(zip(*measures(texts[at:to]), strict=True))
            part = batch.slice(at, to - at)
            yield pa.RecordBatch.from_arrays([column_of(part, "_id"), *(pa.array(c, k) for c, k in zip(rows, KINDS, strict=True))], names=["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])
            at = to


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, united spans (in words) and verdict of each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_column(text_col).alias("_text"))
    found = rows.mapInArrow(measure_rows, f"doc_id long, {COLUMNS}")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("covered_words") <= MAX_COVERED * F.col("n_words")) & (F.col("longest_repeat") <= MAX_REPEAT)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"
    )
