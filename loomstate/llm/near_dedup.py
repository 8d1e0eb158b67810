"""Near-duplicates by MinHash bands, verified first by odd sketches and then on full shingle sets.

1. Each document gives the size and a 128-bit key of its set of word shingles, band hashes of its MinHash samples,
   and an odd sketch: the samples folded into a bitmap of parities, so that the population count of two bitmaps'
   XOR estimates a high similarity. Documents with equal sets form a class; from here on one of them stands for it.
2. Classes that share a band are candidates. First each is held against the smallest of its bucket. A bucket in which
   all then belong to one component is done; the members of any other are compared with each other in blocks of
   bounded size. Sketches are sent to the blocks first; full sets follow only for members that have a near enough
   partner in another component there. Each pair is taken in its first common band and is confirmed in its block,
   so that only links leave a block. No bucket is capped.
3. Pairs that pass the bound on sizes and the sketch, whose margin is many standard deviations, are confirmed on
   their full sets of 64-bit shingle hashes. Components are found by spreading the smallest label, with jumps.

Bands are chosen so that a pair at the threshold is missed with a probability of `miss` at most.

A class's node is its smallest identifier and its key, since rows with the same identifier may have different texts.

Defined results: null text or no words: an empty set, linked with nothing; a null identifier is linked with nothing
and kept, its component null; rows with the same identifier are taken each by its own text, and each belongs to that
text's component; rows equal in identifier and text stay or go together; texts count whole, however long; other columns,
whatever their names, stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_of, columns_of, give_back, lean, read_table, stored, text_column, texts_of

#: MinHash samples and bits of a sketch; members of a block, and shingles of all of them if these are shared out evenly.
SAMPLES, BITS, BLOCK, BLOCK_SHINGLES = 384, 1024, 1024, 8_000_000
#: Rows of two numbers that may be broadcast (32 MB), beyond which a shuffle joins.
BROADCAST_IDS = 2_000_000
#: Samples beside a band's rows, so that a pair just at the threshold is missed this often at most.
MISS = 1e-7
#: A word cache's entries in each worker.
WORDS = 150_000
#: Rows of a part of the graph's tables, and parts at least: a round over few links shouldn't write as many files as a large shuffle has.
PART_ROWS, PARTS = 100_000, 8
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def bands_for(threshold: float, miss: float = MISS, rows: int = 6) -> tuple[int, int]:
    """(bands, rows) that miss a pair at the threshold with that probability."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows))), rows


class Words(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = Words()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted; A-Z lower-cased; fewer words than width: all of them as one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    acc = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        acc = mix(acc * M1 + ids[i : len(words) - span + 1 + i])
    return np.unique(acc)


def signature(items: np.ndarray, samples: int) -> np.ndarray:
    """MinHash samples of a set of 64-bit hashes."""
    rng = np.random.default_rng(20)
    a, b = (rng.integers(1, 2**32, samples, np.uint32)[:, None] | np.uint32(1)), rng.integers(0, 2**32, samples, np.uint32)[:, None]
    low = (items >> np.uint64(32)).astype(np.uint32)
    found = None
    for at in range(0, len(low), 256):
        part = (low[at : at + 256][None, :] * a + b).min(axis=1)
        found = part if found is None else np.minimum(found, part)
    return found


def odd_sketch(sig: np.ndarray, bits: int) -> np.ndarray:
    at = mix(sig.astype(np.uint64) + (np.arange(len(sig), dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def most_differing(threshold: float, samples: int, bits: int, sigmas: float = 4.5) -> int:
    """The XOR's population count up to which a pair may still reach the threshold, less so many standard deviations."""
    low = threshold - sigmas * math.sqrt(threshold * (1 - threshold) / samples)
    mean = bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - low)))
    return math.ceil(mean + 3 * math.sqrt(bits) / 4)


FEATURES = "doc_id long, raw long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>"
NODE = "struct<id:bigint,key:bigint>"


def set_key(items: np.ndarray) -> int:
    return int(mix(items ^ M1).sum().view(np.int64))


@lean
def feature_rows(parts: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple, tuple] = {}
    for batch in parts:
        out = []
        for doc_id, raw, text in zip(column_of(batch, "doc_id").to_pylist(), column_of(batch, "raw").to_pylist(), texts_of(batch, "text"), strict=True):
            items = shingles(text, width)
            if not len(items):
                out.append((doc_id, raw, 0, 0, 0, [], []))
                continue
            key = (len(items), set_key(items), int(np.bitwise_xor.reduce(mix(items + M2)).view(np.int64)))
            if key not in seen:
                if len(seen) >= 2000:
                    seen.clear()
                sig = signature(items, max(SAMPLES, bands * rows))
                banded = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
                acc = np.arange(bands, dtype=np.uint64)
                for i in range(rows):
                    acc = mix(acc * M1 + banded[:, i])
                seen[key] = (acc.view(np.int64).tolist(), odd_sketch(sig, BITS).tolist())
            out.append((doc_id, raw, *key, *seen[key]))
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
        columns = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])


@lean
def set_rows(parts: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The full sets by node, each once from a task."""
    told: set[tuple] = set()
    for batch in parts:
        nodes, sets = [], []
        for doc_id, text in zip(column_of(batch, "doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
            items = shingles(text, width)
            if len(items) and (node := (doc_id, set_key(items))) not in told:
                told.add(node)
                nodes.append(node)
                sets.append(items.tobytes())
        found = [pa.array([x[k] for x in nodes], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(found, ["id", "key"]), pa.array(sets, pa.binary())], names=["rep", "items"])


@lean
def confirm_rows(parts: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        pairs = zip(column_of(batch, "items_a").to_pylist(), column_of(batch, "items_b").to_pylist(), strict=True)
        keep = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([column_of(batch, "a"), column_of(batch, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, without repeats, are so similar."""
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return 100 * both >= percent * (len(x) + len(y) - both)


class Block:
    """The members of a block, or of two blocks, of a bucket, and which of them are candidates."""

    def __init__(self, table: pa.Table, percent: int, most: int):
        number = lambda c: table.column(c).to_numpy()
        grid = lambda c: table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        self.side, self.size, self.at = (number(c) for c in ("side", "n_shingles", "at"))
        self.comp = np.unique(np.stack([number("comp_id"), number("comp_key")], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        self.sketch, self.bands = grid("sketch").view(np.uint64), grid("bands")
        self.percent, self.most = percent, most
        self.left, self.right = np.flatnonzero(self.side != 1), np.flatnonzero(self.side != 0)  # side 2: both are the same block

    def candidates(self, i: int) -> np.ndarray:
        """Members of other components, near enough to the i-th in size and by sketch, whose first common band is here; the nearest first."""
        js = self.right[(self.comp[self.right] != self.comp[i]) & ((self.right > i) if self.side[i] == 2 else True)]
        js = js[100 * np.minimum(self.size[js], self.size[i]) >= self.percent * np.maximum(self.size[js], self.size[i])]
        differ = np.bitwise_count(self.sketch[js] ^ self.sketch[i]).sum(axis=1)
        js, differ = js[differ <= self.most], differ[differ <= self.most]
        mine = (self.bands[js] == self.bands[i]).argmax(axis=1) == self.at[i]
        return js[mine][np.argsort(differ[mine], kind="stable")]


def with_candidates(percent: int, most: int):
    def members(table: pa.Table) -> pa.Table:
        block, some = Block(table, percent, most), np.zeros(table.num_rows, bool)
        for i in block.left.tolist():
            if len(js := block.candidates(i)):
                some[i] = some[js] = True
        give_back()
        return table.filter(pa.array(some))

    return members


def block_links(percent: int, most: int):
    def links(table: pa.Table) -> pa.Table:
        return linked_in_block(table, percent, most)

    return links


def linked_in_block(table: pa.Table, percent: int, most: int) -> pa.Table:
    """Confirmed links between different components: candidates are held against their full sets unless links found before have joined them."""
    block, items, parent = Block(table, percent, most), table.column("items"), {}
    sets: dict[int, np.ndarray] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    def whole(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(items[i].as_py(), np.uint64)
        return sets[i]

    found = []
    for i in block.left.tolist():
        for j in block.candidates(i).tolist():
            a, b = root(int(block.comp[i])), root(int(block.comp[j]))
            if a != b and alike(whole(i), whole(j), percent):
                parent[max(a, b)] = min(a, b)
                found.append((i, j))
    del sets
    give_back()
    of = lambda k: pa.StructArray.from_arrays([table.column(c).take(pa.array([x[k] for x in found], pa.int64())).combine_chunks() for c in ("rep_id", "rep_key")], ["id", "key"])
    return pa.table({"a": of(0), "b": of(1)})


def components(edges: DataFrame, most: int) -> DataFrame:
    """node, comp (the smallest node reachable) of every node that has an edge (a, b). most: a bound on the edges' number."""
    kept = lambda df, tag: stored(df.coalesce(max(PARTS, math.ceil(2 * most / PART_ROWS))), tag)
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "label")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("comp").alias("next")), "b").groupBy(F.col("a").alias("node")).agg(F.min("next").alias("next"))
        low = label.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "next").alias("comp"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        found = kept(low.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "label")
        label = found.select("node", "comp")
        if found.where("was <> comp").isEmpty():
            return label


class Linker:
    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_key().alias("raw"), text_column().alias("text"))
        self.width, self.percent = width, percent
        self.bands, self.rows = bands_for(percent / 100)
        self.labels: DataFrame | None = None
        self.most = 0  # nodes of labels at most

    def sets(self, nodes: DataFrame) -> DataFrame:
        """rep, items: the full shingle sets of those nodes (rep), and of other texts of their identifiers."""
        ids = stored(nodes.select(F.col("rep.id").alias("doc_id")).distinct(), "ids")
        small = ids.count() <= BROADCAST_IDS
        rows = self.docs.join(F.broadcast(ids) if small else ids.hint("merge"), "doc_id", "left_semi")
        return stored(rows.mapInArrow(partial(set_rows, width=self.width), f"rep {NODE}, items binary"), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), each there once, those whose full sets are as similar as asked."""
        pairs = stored(pairs, "pairs")
        sets = self.sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")))
        of = lambda c: sets.select(F.col("rep").alias(c), F.col("items").alias(f"items_{c}"))
        held = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "items_a", "items_b")
        return held.mapInArrow(partial(confirm_rows, percent=self.percent), f"a {NODE}, b {NODE}")

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows with comp, the component of their rep so far."""
        if self.labels is None:
            return rows.withColumn("comp", F.col("rep"))
        known = self.labels.select(F.col("node").alias("rep"), F.col("comp").alias("_c"))
        return rows.join(known, "rep", "left").withColumn("comp", F.coalesce("_c", "rep")).drop("_c")

    def merge(self, links: DataFrame) -> None:
        """Merges the components that confirmed links (a, b) join."""
        links = stored(links, "links")
        if n := links.count():
            edges = n + self.most
            if self.labels is not None:  # each node stays with its component
                links = links.union(self.labels.where("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b")))
            self.labels, self.most = components(links, edges), 2 * edges

    def run(self) -> DataFrame:
        """doc_id, raw (the text's hash), n_shingles, component_id of each row."""
        features = stored(self.docs.mapInArrow(partial(feature_rows, width=self.width, bands=self.bands, rows=self.rows), FEATURES), "features")
        key = ["k1", "k2", "n_shingles"]
        full = features.where("n_shingles > 0 and doc_id is not null")
        node = F.struct(F.col("id"), F.col("k1").alias("key")).alias("rep")
        classes = full.groupBy(*key).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        classes = stored(classes.select(*key, node, "bands", "sketch"), "classes")
        members = classes.select("rep", "n_shingles", F.explode("bands").alias("band"))
        buckets = members.groupBy("band").agg(F.count("*").alias("m"), F.min("rep").alias("hub")).where("m > 1")
        members = stored(members.join(buckets, "band").select("band", "rep", "hub", "m", "n_shingles"), "members")
        info = classes.select("rep", "n_shingles", "sketch")
        of = lambda c: info.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
        near = members.where("rep > hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct().join(of("b"), "b").join(of("a"), "a")
        differ = F.expr("aggregate(zip_with(s_a, s_b, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)")
        fits = F.expr(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)")
        last = most_differing(self.percent / 100, max(SAMPLES, self.bands * self.rows), BITS)
        self.merge(self.confirmed(near.where(fits & (differ <= last)).select("a", "b")))
        here = stored(self.labelled(members.where("m > 2").select("band", "rep", "m", "n_shingles")), "here")
        blocks = F.ceil(F.greatest(F.max("m") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
        bands = here.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks.alias("blocks")).where("lo < hi").select("band", "blocks")
        bands = stored(bands, "bands")
        few = bands.count() <= BROADCAST_IDS
        alive = stored(here.join(F.broadcast(bands) if few else bands.hint("merge"), "band").select("band", "rep", "comp", "blocks"), "alive")
        dealt = alive.join(classes.select("rep", "n_shingles", "bands", "sketch"), "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
            "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("rep.id").alias("rep_id"), F.col("rep.key").alias("rep_key"),
            F.col("comp.id").alias("comp_id"), F.col("comp.key").alias("comp_key"), "n_shingles", "sketch", "bands",
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), (F.array_position("bands", F.col("band")) - 1).alias("at"),
        )
        near = stored(dealt.groupBy("band", "i", "j").applyInArrow(with_candidates(self.percent, last), dealt.schema), "near")
        rep = F.struct(F.col("rep_id").alias("id"), F.col("rep_key").alias("key")).alias("rep")
        near = near.join(self.sets(near.select(rep)), rep == F.col("rep")).drop("rep")
        self.merge(near.groupBy("band", "i", "j").applyInArrow(block_links(self.percent, last), f"a {NODE}, b {NODE}").distinct())
        found = self.labelled(classes.select(*key, "rep")).select(*key, F.col("comp.id").alias("comp"))
        linked = features.where("n_shingles > 0").select("doc_id", "raw", *key).join(found, key, "left")
        bare = features.where("n_shingles = 0").select("doc_id", "raw", "n_shingles", F.col("doc_id").alias("component_id"))
        component = F.when(F.col("doc_id").isNotNull(), F.col("comp"))
        return linked.select("doc_id", "raw", "n_shingles", component.alias("component_id")).union(bare)


def raw_key():
    """With the identifier, this tells a row from others of another text."""
    return F.xxhash64(text_column())


def linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    found = Linker(docs, width, percent).run()
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    return linked(docs, width, percent).drop("raw")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component the smallest doc_id. A row goes by its identifier and its text."""
    gone = stored(linked(docs, width, percent).where("not kept").select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw")).distinct(), "gone")
    small = gone.count() <= BROADCAST_IDS
    rows = docs.select(F.struct(*columns_of(docs)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), raw_key().alias("_raw"))
    return rows.join(F.broadcast(gone) if small else gone.hint("merge"), ["_id", "_raw"], "left_anti").select("_row.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)


OP8_SQL = r"""WITH RECURSIVE split AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM split),
grams AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.sh) + len(y.sh) - n)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY ALL)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_of USING (doc_id)"""
