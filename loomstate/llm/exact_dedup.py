"""Exact dedup by Patricia-trie owners.

A text is normalised by turning each run of ASCII white space into one space. Each input task first inserts its
texts into a compressed radix trie of its own and passes on one row for each distinct text, so that a group of
copies that holds a third of all rows leaves a task as one row. Those rows are dealt by length and content hash;
the task that owns a (length, hash) part inserts the full byte strings into its trie, where a terminal node holds
the smallest identifier, how many rows bear it, and the group's size. If a trie outgrows its memory, its heaviest
subtree moves to an unnamed temporary file of the task, and is finished on its own afterwards; a task that is run again
begins with its rows, so nothing is lost with the file.

Rows meet their groups by the text's hash. A group that has a HEAVY-th of all rows or more would fill a task; there are
HEAVY of them at most, so they are broadcast, and their rows are dealt by their identifiers.

Defined results: a null text is an empty text; a null identifier is larger than any other, and stays only if the whole group
has none; of repeated rows with the same identifier and text exactly one stays; texts of any length are compared whole; other
columns, whatever their names, stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, column_of, columns_of, lean, read_table, stored, text_column, texts_of

#: Bytes of labels that an input task's trie gathers before it passes them on, and that an owner's holds before it spills.
LOCAL_BYTES, OWNER_BYTES = 24 << 20, 96 << 20
#: Groups with a HEAVY-th of all rows; rows to drop that may be broadcast (16 MB of numbers), beyond which a shuffle joins.
HEAVY, BROADCAST_GONE = 10_000, 1_000_000


class Node:
    __slots__ = ("count", "ident", "kids", "label", "same", "spill")

    def __init__(self, label: bytes):
        self.label, self.kids, self.count, self.same, self.ident, self.spill = label, {}, 0, 0, None, None


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving, so that long labels cost few comparisons."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class PatriciaTrie:
    """Byte strings to (smallest identifier, rows that bear it, rows). limit: bytes of labels held before spilling."""

    def __init__(self, limit: int | None = None):
        self.root, self.held, self.limit = Node(b""), 0, limit

    def insert(self, key: bytes, ident: int | None, same: int = 1, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            if node.spill:
                break
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.held += len(key) - at + 200
                node, at = kid, len(key)
            elif key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
            else:
                cut = common_prefix(kid.label, key[at : at + len(kid.label)])
                fork = node.kids[key[at]] = Node(kid.label[:cut])
                kid.label = kid.label[cut:]
                fork.kids[kid.label[0]] = kid
                self.held += 200
                node, at = fork, at + cut
        if node.spill:
            node.spill.add(key, ident, same, count)
            return
        if node.count == 0 or node.ident is None and ident is not None or ident is not None and ident < node.ident:
            node.ident, node.same = ident, same
        elif ident == node.ident:
            node.same += same
        node.count += count
        if self.limit and self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        """Moves the heaviest subtree under the first fork to a file; keys that lead there follow it."""
        node, prefix = self.root, b""
        while len(live := [k for k in node.kids.values() if not k.spill]) == 1 and not node.count:
            node, prefix = live[0], prefix + live[0].label
        size, kid = max(((self._size(k), k) for k in live), key=lambda x: x[0], default=(0, None))
        if kid is None:
            return  # one text alone, which can't be parted; the next that differs can
        file = Spill()
        for key, (ident, same, count) in self._walk(kid, prefix):
            file.add(key, ident, same, count)
        for below in self._files(kid):
            for row in below.rows():
                file.add(*row)
        kid.label, kid.kids, kid.count, kid.spill = kid.label[:1], {}, 0, file
        self.held -= size - 201

    @staticmethod
    def _size(node: Node) -> int:
        total, rest = 0, [node]
        while rest:
            n = rest.pop()
            total += len(n.label) + 200
            rest.extend(n.kids.values())
        return total

    @staticmethod
    def _files(node: Node) -> list["Spill"]:
        found, rest = [], [node]
        while rest:
            n = rest.pop()
            found += [n.spill] if n.spill else []
            rest.extend(n.kids.values())
        return found

    @staticmethod
    def _walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, tuple]]:
        rest = [(node, prefix)]
        while rest:
            n, before = rest.pop()
            key = before + n.label
            if n.count:
                yield key, (n.ident, n.same, n.count)
            rest.extend((k, key) for k in n.kids.values())

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """All texts; those in memory first, then the spilled subtrees one after the other."""
        limit, root = self.limit, self.root
        files = self._files(root)
        yield from self._walk(root, b"")
        self.root, self.held, root = Node(b""), 0, None
        for file in files:
            part = PatriciaTrie(limit)
            for row in file.rows():
                part.insert(*row)
            yield from part.items()


class Spill:
    """Rows of a subtree in an unnamed temporary file, which goes with the process."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def add(self, key: bytes, ident: int | None, same: int, count: int) -> None:
        self.file.write(b"%d %d %d %d %d\n" % (len(key), ident is not None, ident or 0, same, count) + key)

    def rows(self) -> Iterator[tuple]:
        self.file.seek(0)
        while line := self.file.readline():
            size, known, ident, same, count = map(int, line.split())
            yield self.file.read(size), ident if known else None, same, count
        self.file.close()


LOCAL = pa.schema([("content", pa.binary()), ("ident", pa.int64()), ("same", pa.int64()), ("n", pa.int64())])
OWNED = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("same", pa.int64()), ("group_size", pa.int64())])


def _rows(items: Iterator[tuple[bytes, tuple]], name: Callable, schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for key, found in items:
        held.append((name(key), *found))
        weight += len(key)
        if weight >= size or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


@lean
def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An input task's own trie; passed on and begun anew when it is full."""
    trie = PatriciaTrie()
    for batch in parts:
        for key, ident in zip(texts_of(batch, "content"), column_of(batch, "ident").to_pylist(), strict=True):
            trie.insert(key, ident)
            if trie.held > LOCAL_BYTES:
                yield from _rows(trie.items(), bytes, LOCAL)
                trie = PatriciaTrie()
    yield from _rows(trie.items(), bytes, LOCAL)


@lean
def own(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The owner's trie over all that has been dealt to it."""
    trie = PatriciaTrie(OWNER_BYTES)
    for batch in parts:
        cols = [texts_of(batch, "content"), *(column_of(batch, c).to_pylist() for c in ("ident", "same", "n"))]
        for row in zip(*cols, strict=True):
            trie.insert(*row)
    yield from _rows(trie.items(), lambda key: hashlib.sha256(key).hexdigest(), OWNED)


def normalised(text: str = "text"):
    return F.regexp_replace(text_column(text), SPACES, " ")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each distinct normalised text: text_sha256, keep_id, same (rows that bear keep_id), group_size."""
    content = docs.select(normalised(text_col).cast("binary").alias("content"), F.col(id_col).cast("long").alias("ident"))
    local = content.mapInArrow(gather, "content binary, ident long, same long, n long")
    dealt = local.repartition(F.length("content"), F.xxhash64("content"))
    return dealt.mapInArrow(own, "text_sha256 string, keep_id long, same long, group_size long")


def sha(text_col: str = "text"):
    return F.sha2(normalised(text_col).cast("binary"), 256)


def with_groups(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (doc_id, text_sha256 and others) with keep_id, same, group_size of their groups (stored), and part, equal for equal texts of one identifier."""
    total = found.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n"))
    sized = found.join(F.broadcast(total)).withColumn("heavy", F.col("group_size") * HEAVY >= F.col("n"))
    of = lambda name: F.struct("keep_id", "same", "group_size").alias(name)
    heavy = sized.where("heavy").select("text_sha256", of("_heavy"))
    light = sized.where("not heavy").select(F.col("text_sha256").alias("part"), of("_light"))
    part = F.when(F.col("_heavy").isNull(), F.col("text_sha256")).otherwise(F.concat(F.lit("id "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    marked = rows.join(F.broadcast(heavy), "text_sha256", "left").withColumn("part", part)
    return marked.join(light.hint("merge"), "part", "left").withColumn("g", F.coalesce("_heavy", "_light")).select("part", *rows.columns, "g.*")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), sha(text_col).alias("text_sha256"))
    found = with_groups(rows, stored(groups(docs, id_col, text_col), "groups"))
    first = F.row_number().over(Window.partitionBy("part", "text_sha256", "doc_id").orderBy("doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (first == 1)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns. Rows are told by identifier and a hash of their text as it is; the
    list of those that go is small or is joined by a shuffle. Rows equal in both are numbered, if there are any, and one stays."""
    ident, raw = F.col(id_col).cast("long"), F.xxhash64(text_column(text_col))
    rows = docs.select(ident.alias("doc_id"), sha(text_col).alias("text_sha256"), raw.alias("h"))
    found = with_groups(rows, stored(groups(docs, id_col, text_col), "groups")).withColumn("first", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    odd = stored(found.where("not first or same > 1").select("part", "text_sha256", "doc_id", "h", "first"), "odd")
    lowest = odd.where("first").groupBy("part", "text_sha256", "doc_id").agg(F.min("h").alias("h"))
    again = stored(lowest.select("doc_id", "h"), "again")
    others = odd.where("first").select("doc_id", "h").distinct()
    others = others.join(again, others["doc_id"].eqNullSafe(again["doc_id"]) & (others["h"] == again["h"]), "left_anti")
    gone = stored(odd.where("not first").select("doc_id", "h").union(others), "gone")
    row = docs.select(F.struct(*columns_of(docs)).alias("_row"), ident.alias("_id"), raw.alias("_h"))

    def joined(left: DataFrame, right: DataFrame, n: int, how: str) -> DataFrame:
        small = F.broadcast(right) if n <= BROADCAST_GONE else right.hint("merge")
        return left.join(small, left["_id"].eqNullSafe(right["doc_id"]) & (left["_h"] == right["h"]), how)

    rest = joined(row, gone, gone.count(), "left_anti")
    if n := again.count():
        first = F.row_number().over(Window.partitionBy("_id", "_h").orderBy("_id"))
        numbered = joined(rest, again, n, "left_semi").withColumn("_first", first).where("_first = 1")
        rest = joined(rest, again, n, "left_anti").select("_row").union(numbered.select("_row"))
    return rest.select("_row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(read_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
