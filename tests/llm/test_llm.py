"""Every operator against brute force, and on odd rows: nulls, empty and long texts, ties, no rows, clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from loomstate.llm import exact_dedup, lattice_lm, licenses, line_crf, mixing, near_dedup, packing, repetition, sharding, token_orc
from loomstate.llm.common import fold, read_table
from loomstate.llm.encoding import Encoder, vocabulary

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id long, _row string, _text string, comp long, rep long"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(20000))
ODD = [(1, "a b c d e f"), (2, "a  b\tc d e f"), (3, None), (4, ""), (5, "one"), (5, "one"), (None, "a b c d e f"), (6, LONG), (7, LONG + " end"), (8, "\n\n \x1c\u0085 ﬁ 😀 é"), (2, "other")]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, None if k % 2 else "en", None if k % 3 else "s", None, 1, "x", "y", 2, 3) for k, (i, t) in enumerate(rows)], COLUMNS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in read_table(spark, SF, "documents").collect()}


def test_trie_spills_and_stays_right():
    keys = [(b"common-" * 3 + hashlib.md5(str(i % 70).encode()).hexdigest().encode()[: i % 30 + 1], i) for i in range(2000)]
    told = collections.defaultdict(list)
    for key, i in keys:
        told[key].append(i)
    for limit in (None, 4000):
        trie = exact_dedup.PatriciaTrie(limit)
        for key, i in keys:
            trie.insert(key, i)
        assert {k: (v[0], v[2]) for k, v in trie.items()} == {k: (min(v), len(v)) for k, v in told.items()}


def test_trie_keeps_its_limit_behind_a_text_that_exceeds_it():
    trie = exact_dedup.PatriciaTrie(10_000)
    keys = [b"a" * 20_000, *(hashlib.md5(str(i).encode()).digest() * 25 for i in range(500)), b"a" * 19_999 + b"b", b"a"]
    for i, key in enumerate(keys):
        trie.insert(key, i)
    assert trie.limit == 10_000 and trie.held < 10_000 + 257 * 201  # what has moved leaves a node each
    in_memory = sum(len(n.label) for n in nodes_of(trie))
    assert in_memory < 12_000
    assert {k: v for k, v in trie.items()} == {k: (i, 1, 1) for i, k in enumerate(keys)}


def nodes_of(trie):
    rest, found = [trie.root], []
    while rest:
        found.append(rest.pop())
        rest += found[-1].kids.values()
    return found


@pytest.mark.parametrize("heavy, few", [(10_000, 1_000_000), (1, 1_000_000), (10_000, 0)])
def test_exact_dedup_by_every_way(spark, monkeypatch, heavy, few):
    """Heavy groups or none, and lists that are broadcast or not, give the same rows."""
    monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
    monkeypatch.setattr(exact_dedup, "BROADCAST_GONE", few)
    rows = [*ODD, *ODD, *((100 + i, "hot\ttext") for i in range(40)), (100, "hot  text"), (None, None), (None, "alone"), (None, "alone")]
    plain = collections.defaultdict(list)
    for i, t in rows:
        plain[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    lowest = lambda ids: min((i for i in ids if i is not None), default=None)
    found = exact_dedup.mark_copies(odd(spark, rows)).collect()
    want = sorted(str((i, lowest(ids), len(ids), hashlib.sha256(t.encode()).hexdigest())) for t, ids in plain.items() for i in ids)
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in found) == want
    kept = collections.Counter((r["text_sha256"], r["doc_id"]) for r in found if r["kept"])
    assert kept == {(hashlib.sha256(t.encode()).hexdigest(), lowest(ids)): 1 for t, ids in plain.items()}
    rest = exact_dedup.drop_copies(odd(spark, rows).withColumnRenamed("rep", "a.b")).collect()
    told = sorted((str(r["doc_id"]), re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in rest)
    assert told == sorted((str(lowest(ids)), t) for t, ids in plain.items()) and "a.b" in rest[0].asDict()


def test_exact_dedup_odd_rows(spark):
    found = exact_dedup.mark_copies(odd(spark)).collect()
    assert len(found) == len(ODD)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found if r["doc_id"] in (1, 3, 4, 5)) == [(1, 1, 3, True), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 2, False), (5, 5, 2, True)]
    kept = exact_dedup.drop_copies(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 7
    assert exact_dedup.mark_copies(odd(spark).limit(0)).count() == 0


def brute_links(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    low = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i]) for i in ids}


def test_near_dedup(spark, docs):
    found = entry.queries()["op8_near_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_links(docs, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_dedup_chains_in_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = [f"t{i}" for i in range(120)]
    texts = {k: " ".join([f"c{k}_{i}" if i in (k % 40 * 3, k * 7 % 120) else w for i, w in enumerate(base)]) for k in range(30)}
    found = near_dedup.near_duplicates(odd(spark, list(texts.items())), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_links(texts, 3, 85)


TWICE = [(1, "a b c d e f"), (2, "a  b c d e f"), (2, "other words that are no copy"), (2, "p q r s t u v"), (3, "p q r s t u v"), (4, "other words  that are no copy"), (4, "x"), (5, None), (5, None), (None, "p q r s t u v"), (6, "X"), (6, "X")]


@pytest.mark.parametrize("ids", [2_000_000, 0])
def test_near_dedup_takes_rows_of_one_identifier_by_their_texts(spark, monkeypatch, ids):
    """Links of one text of an identifier say nothing of another: no text is lost, and lists are joined in both ways."""
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", ids)
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_dedup.near_duplicates(odd(spark, TWICE)).collect())
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 2, True), (2, 3, 2, True), (3, 3, 2, False), (4, 2, 2, False), (4, 1, 4, True), (5, 0, 5, True), (5, 0, 5, True), (None, 3, None, True), (6, 1, 4, False), (6, 1, 4, False)]
    assert found == sorted((str(a), b, str(c), d) for a, b, c, d in want)
    rest = near_dedup.drop_near_duplicates(odd(spark, TWICE).withColumnRenamed("rep", "a.b"))
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in rest.collect())
    assert kept == sorted((str(i), str(t)) for (i, t), (*_, k) in zip(TWICE, want) if k) and "a.b" in rest.columns


def test_near_dedup_odd_rows(spark):
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd(spark)).collect()}
    assert {(1, 1, True), (3, 3, True), (6, 6, True), (7, 6, False), (None, None, True)} <= found
    assert near_dedup.near_duplicates(odd(spark).limit(0)).count() == 0


ADDED = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "<|endoftext|", "< |endoftext|>"]


def test_encoding_equals_the_library():
    """Against a library as it loads, also where its added tokens stand at an end of a text or inside a word."""
    rng = np.random.default_rng(3)
    parts = [*"abcXYZ  \n\t.,'!0129éÉßİſΣσ中\u0085́\x1c|$½²ªǅ", "'s", "'ll", " 's", *ADDED, "  ", "\r\n"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(1500)]
    texts += [a + x + b for x in ADDED for a in ("", "hi", "hi ", "\n") for b in ("", "there", " there", "\n")] + [x + y for x in ADDED for y in ADDED]
    plain = [t for t in texts if not any(x in t for x in ADDED)]
    assert len(plain) > 200
    for name, spaces in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        e, library = Encoder(vocabulary(name), spaces), Tokenizer.from_file(vocabulary(name))
        assert not library.encode_special_tokens and {"<|"} == e.marks
        assert all(e(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts)
        ordinary = Encoder(vocabulary(name), spaces, added=False)
        assert ordinary("a<|endoftext|>b") != e("a<|endoftext|>b") and all(ordinary(t) == e(t) for t in plain)


def test_token_orc(spark, docs, tmp_path):
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    start, told = 0, []
    for i in sorted(docs):
        ids = [*library.encode(docs[i], add_special_tokens=False).ids, 2]
        told.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in entry.queries()["op2_token_orc"](spark, SF).orderBy("doc_id").collect()] == told
    path = str(tmp_path / "orc")
    token_orc.write_token_orc(odd(spark, [*ODD, (9, "a <|endoftext|> b")]), path, vocabulary("word_bpe_49k.json"))
    back = token_orc.read_token_orc(spark, path).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in back) == sorted((i is not None, i or 0, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in [*ODD, (9, "a <|endoftext|> b")])
    assert [r["n_tokens"] for r in token_orc.look_up(spark, path, [3]).collect()] == [1]


def test_token_orc_prunes_by_metadata(spark, tmp_path, monkeypatch):
    """Files have many stripes, with statistics, row indexes and Bloom filters, and a look-up reads few rows of few of them."""
    from pyarrow import orc

    monkeypatch.setattr(token_orc, "STRIPE_BYTES", 1 << 18)
    path, rows = str(tmp_path / "orc"), 40_000
    docs = spark.range(rows).selectExpr("id * 3 as doc_id", "concat_ws(' ', transform(sequence(1, 40), k -> hex(hash(id, k)))) as text")
    token_orc.write_token_orc(docs, path, vocabulary("word_bpe_49k.json"), files=3)
    files = sorted(p for p in (tmp_path / "orc").iterdir() if p.suffix == ".orc")
    held = [orc.ORCFile(p) for p in files]
    assert len(held) == 3 and sum(f.nrows for f in held) == rows
    assert [f.row_index_stride for f in held] == [token_orc.INDEX_ROWS] * 3 and all(f.nstripes > 1 for f in held)
    first = [f.read(columns=["doc_id"])["doc_id"] for f in held]
    ranges = sorted((c[0].as_py(), c[-1].as_py()) for c in first)
    assert all(a <= b for a, b in ranges) and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))

    def rows_scanned(ids):
        df = token_orc.look_up(spark, path, ids)
        found = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return found, sum(leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.size()))

    found, scanned = rows_scanned([30_000])
    assert [r["doc_id"] for r in found] == [30_000] and 0 < scanned <= 2 * 1024 + token_orc.INDEX_ROWS
    found, scanned = rows_scanned([30_001])  # within the statistics' ranges; only a Bloom filter tells
    assert not found and scanned == 0


def naive_patterns(lengths, room):
    """Shortest pack first, a piece at a time: the longest pieces first, each into the pack with most room left."""
    packs = []
    for length in sorted(lengths, reverse=True):
        best = max(range(len(packs)), key=lambda k: packs[k][0], default=None)
        if best is None or packs[best][0] < length:
            packs.append([room, []])
            best = len(packs) - 1
        packs[best][0] -= length
        packs[best][1].append(length)
    return packs


def test_packing_is_shortest_pack_first():
    rng = np.random.default_rng(5)
    for room, n in ((16, 200), (64, 500), (1024, 300)):
        lengths = rng.integers(1, room + 1, n).tolist() + [room // 3] * 40
        found = packing.shortest_pack_first(collections.Counter(lengths), room)
        packs = naive_patterns(lengths, room)
        assert sum(k for _, k in found) == len(packs)
        assert sorted(x for p, k in found for _ in range(k) for x in p) == sorted(lengths)
        assert sorted(room - sum(p) for p, k in found for _ in range(k)) == sorted(free for free, _ in packs)


def packed_ids(rows):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]


def test_packing(spark, docs):
    told = dict(packed_ids(docs.items()))
    found = entry.queries()["op7_packing"](spark, SF).collect()
    at = collections.defaultdict(list)
    for r in found:
        ids = told[r["doc_id"]]
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert (len(piece), len(ids), zlib.crc32(np.array(piece, "<u4").tobytes())) == (r["length"], r["doc_tokens"], r["ids_crc32"])
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(at) == list(range(len(at))) and len(at) == len(naive_patterns([r["length"] for r in found], 1024))
    assert sum(r["length"] for r in found) == sum(map(len, told.values()))
    for places in at.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024


@pytest.mark.parametrize("part_rows", [100_000, 3])
def test_packing_odd_rows(spark, part_rows):
    """Nulls, repeated rows, equal identifiers, long texts: every id is in just one place, whatever the number of parts."""
    rows = [*ODD, *ODD[4:7], (5, "two words"), (9, "a<|endoftext|>b"), *((None, None) for _ in range(5))]
    docs = odd(spark, rows).withColumnsRenamed({"rep": "length", "comp": "_part"})
    cut = packing.pieces(docs, vocabulary("byte_bpe_50k.json"), with_ids=True)
    found = packing.assign(cut.cache(), part_rows=part_rows).collect()
    at = collections.defaultdict(dict)
    for r in found:
        for k in range(r["length"]):
            assert r["offset"] + k not in at[r["sequence_id"]]
            at[r["sequence_id"]][r["offset"] + k] = int.from_bytes(r["ids"][4 * k : 4 * k + 4], "little")
    assert all(sorted(x) == list(range(len(x))) and len(x) <= 1024 for x in at.values()) and sorted(at) == list(range(len(at)))
    pieces = [(str(i), k, tuple(ids[k : k + 1024])) for i, ids in packed_ids(rows) for k in range(0, len(ids), 1024)]
    assert sorted((str(r["doc_id"]), r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in found) == sorted(pieces)
    whole = packing.sequences(docs, vocabulary("byte_bpe_50k.json")).collect()
    assert sorted(x for r in whole for x in zip(map(str, r["doc_ids"]), r["starts"])) == sorted(p[:2] for p in pieces)
    assert sorted(np.frombuffer(b"".join(r["ids"] for r in whole), "<u4").tolist()) == sorted(x for *_, p in pieces for x in p)
    assert packing.pack(odd(spark).limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_sharding(spark):
    found = entry.queries()["op5_sharding"](spark, SF).collect()
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 40 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    rows = [(i, "t") for i in range(3000)]
    old, new = ({r["doc_id"]: r["shard"] for r in sharding.shard_rows(odd(spark, rows), ["doc_id"], shards=n).collect()} for n in (20, 21))
    assert sum(old[i] != new[i] for i in old) < 0.2 * len(old)  # 1 / 21 at least; a modulo moves 95 %
    many = spark.range(30_000).withColumnRenamed("id", "doc_id")
    old, new = ({r["doc_id"]: r["shard"] for r in sharding.shard_rows(many, ["doc_id"], shards=n).collect()} for n in (40, 41))
    assert 1 / 41 - 0.001 < sum(old[i] != new[i] for i in old) / len(old) < 0.08
    assert sharding.shard_rows(odd(spark), ["doc_id"]).count() == len(ODD)
    assert sharding.shard_rows(odd(spark).limit(0), ["doc_id"]).count() == 0


def test_quality(spark):
    larger = SF.replace("0.001", "0.01")  # 270 labelled documents to learn from; the smallest tables have 76 in all
    found = entry.queries()["op1_line_crf"](spark, larger).join(read_table(spark, larger, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) >= 0.95 * len(found)
    scores = line_crf.scored(odd(spark), odd(spark).selectExpr("doc_id", "1 as quality"), ["doc_id"]).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert line_crf.scored(odd(spark).limit(0), odd(spark).selectExpr("doc_id", "1 as quality"), ["doc_id"]).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    odds, moves = rng.normal(size=5), rng.normal(size=(2, 2))
    good, _ = line_crf.Chains(np.array([2, 3])).marginals(odds, moves)
    for first, n in ((0, 2), (2, 3)):
        total, mass = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            p = np.exp(sum(odds[first + k] * y[k] for k in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total, mass = total + p, mass + p * np.array(y)
        assert np.allclose(good[first : first + n], mass / total)


def test_gradient_of_the_fit():
    """Against differences of the conditional log-likelihood, all labelings enumerated."""
    rng = np.random.default_rng(2)
    lengths, width = np.array([3, 1, 4]), line_crf.WIDTH
    x, y = rng.normal(size=(8, width)), np.array([1, 1, 1, 0, 0, 0, 0, 0.0])
    share = np.repeat(1 / lengths / 3, lengths)

    def objective(theta):
        weights, moves = theta[:width], theta[width:].reshape(2, 2)
        odds, total, at = x @ weights, 0.0, 0
        first = {0: 0, 1: 3, 2: 4}
        for d, n in enumerate(lengths.tolist()):
            at = first[d]
            value = lambda lab: sum(odds[at + k] * lab[k] for k in range(n)) + sum(moves[a, b] for a, b in zip(lab, lab[1:]))  # noqa: B023, E731
            own = [int(v) for v in y[at : at + n]]
            every = [value([code >> k & 1 for k in range(n)]) for code in range(2**n)]
            total += share[at] * (value(own) - np.log(np.exp(every).sum()))
        return total - line_crf.RIDGE / 2 * (theta**2).sum()

    theta = rng.normal(size=width + 4) * 0.3
    found = line_crf.gradient(line_crf.Chains(lengths), x, y, share, line_crf.seen_moves(y, share, lengths), theta[:width], theta[width:].reshape(2, 2))
    step = 1e-6 * np.eye(width + 4)
    assert np.allclose(found, [(objective(theta + e) - objective(theta - e)) / 2e-6 for e in step], atol=1e-6)


def test_line_labels(spark):
    """Lines weighted by their bytes make the score; the bad ones are counted."""
    larger = SF.replace("0.001", "0.01")
    docs, labels = read_table(spark, larger, "documents"), read_table(spark, larger, "labels")
    lines = collections.defaultdict(list)
    for r in line_crf.line_labels(docs, labels, ["doc_id"]).collect():
        lines[r["doc_id"]].append((r["line"], r["marginal"], r["good"]))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in line_crf.scored(docs, labels, ["doc_id"]).collect():
        own, sizes = sorted(lines[r["doc_id"]]), [len(x.encode()) + 1 for x in texts[r["doc_id"]].split("\n")]
        assert [k for k, *_ in own] == list(range(len(sizes))) and r["n_lines"] == len(sizes)
        assert r["bad_lines"] == sum(not g for *_, g in own) == sum(m < 0.5 for _, m, _ in own)
        assert np.isclose(r["score"], np.average([m for _, m, _ in own], weights=sizes))
    assert {len(set(g for *_, g in own)) for own in lines.values()} == {1, 2}  # some texts have lines of both kinds


DOTTED = {"rep": "a.b", "comp": "score", "_id": "_all", "_text": "x`y"}


def test_stages_on_odd_rows(spark):
    """Whatever the rows and the names of other columns, a stage returns whole rows of its input, and an empty table for one."""
    docs = odd(spark, [*ODD, *ODD[4:8], (None, None)]).withColumnsRenamed(DOTTED)
    labels = docs.selectExpr("doc_id", "doc_id % 2 as quality")
    given = collections.Counter(map(str, docs.collect()))
    stages = {
        "good": lambda d: line_crf.keep_good(d, labels, 0.0), "exact": exact_dedup.drop_copies, "near": near_dedup.drop_near_duplicates,
        "mix": lambda d: mixing.keep_mix(d, 1.0), "nine tenths": mixing.keep_mix,
    }
    for name, stage in stages.items():
        found = stage(docs)
        rows = collections.Counter(map(str, found.collect()))
        assert found.columns == docs.columns and rows <= given, name
        assert (rows == given) == (name in ("good", "mix")), name
        assert stage(docs.limit(0)).count() == 0, name


def test_mixing_joins_in_both_ways(spark, monkeypatch):
    """A small or a large table of leaves gives the same mix."""
    docs = read_table(spark, SF, "documents").unionByName(read_table(spark, SF, "documents").selectExpr("null as doc_id", "text", "lang", "null as source", "n_chars"))
    mixed = lambda: sorted(map(str, mixing.mix(docs, ["doc_id", "text"], mixing.domain_of()).collect()))
    small = mixed()
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert mixed() == small and small


def test_lattice_sums_all_segmentations():
    path = vocabulary("piece_bpe_32k.model")
    logs = lattice_lm.first_weights(path)
    lattice, table = lattice_lm.Lattice(path, logs), lattice_lm.load_pieces(path)[2]

    def total(text):
        return sum(np.exp(logs[table[text[:k]]]) * total(text[k:]) for k in range(1, len(text) + 1) if table.get(text[:k]) is not None) if text else 1.0

    counts = [0.0] * len(logs)
    for word in ("the", "nation", "ando"):
        assert np.isclose(lattice.score(word.encode()), np.log(total(lattice_lm.SPACE + word)))
        lattice.expect(word.encode(), 1, counts)
    pieces = lattice_lm.load_pieces(path)[0]
    assert np.isclose(sum(n * len(p) for n, p in zip(counts, pieces)), sum(len(w) + 1 for w in ("the", "nation", "ando")))


class PlainLattice:
    """The same model with a dictionary of pieces and one word at a time."""

    def __init__(self, path):
        names, _, table, self.bytes = lattice_lm.load_pieces(path)
        self.ids = {t: i for t, i in table.items() if i is not None}
        self.longest = max(map(len, self.ids))

    def edges(self, word):
        """(from, to, pieces) of a word; a character without a piece goes by its bytes."""
        text = lattice_lm.SPACE + word
        for a in range(len(text)):
            for b in range(a + 1, min(len(text), a + self.longest) + 1):
                if text[a:b] in self.ids:
                    yield a, b, [self.ids[text[a:b]]]
            if text[a] not in self.ids:
                yield a, a + 1, [self.bytes[x] for x in text[a].encode()]

    def forward(self, word, p):
        """Probabilities of all beginnings, and the edges with theirs."""
        edges = [(a, b, ids, float(np.prod([p[i] for i in ids]))) for a, b, ids in self.edges(word)]
        alpha = [1.0] + [0.0] * (len(word) + 1)
        for a, b, _, w in sorted(edges, key=lambda x: x[:2]):
            alpha[b] += alpha[a] * w
        return alpha, edges

    def expect(self, word, p, times, into):
        alpha, edges = self.forward(word, p)
        beta = [0.0] * (len(word) + 1) + [1.0]
        for a, b, _, w in sorted(edges, key=lambda x: -x[0]):
            beta[a] += w * beta[b]
        for a, b, ids, w in edges:
            for i in ids:
                into[i] += times * alpha[a] * w * beta[b] / alpha[-1]


@pytest.mark.parametrize("blocks", [1, 7])
def test_lm_scores_against_a_plain_model(spark, blocks):
    rows = [(1, "The cat sat on the mat"), (2, "the Cat, the cat!"), (3, "unseen 😀x zqx"), (4, None), (5, "mat sat 中 mat"), (5, "mat sat 中 mat"), (None, "dogs"), (8, "a\x0bb\tc  unseen")]
    train = {1, 2, 5}
    path = vocabulary("piece_bpe_32k.model")
    plain, p = PlainLattice(path), np.exp(lattice_lm.first_weights(path))
    split = lambda t: words("".join(c.lower() if c.isascii() else c for c in t or ""))
    counts = collections.Counter(w for i, t in rows if i in train for w in split(t))
    ends = sum(i in train for i, _ in rows)
    for _ in range(lattice_lm.ROUNDS):
        weight = np.full(len(p), lattice_lm.PSEUDO)
        for word, n in counts.items():
            plain.expect(word, p, n, weight)
        weight[-1] += ends
        p = weight / weight.sum()
    want = sorted((str(i), len(split(t)) + 1, round(sum(np.log10(plain.forward(w, p)[0][-1]) for w in split(t)) + np.log10(p[-1]), 6)) for i, t in rows)
    found = lattice_lm.lm_scores(odd(spark, rows), F.coalesce(F.col("doc_id").isin(*train), F.lit(False)), path, blocks).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in found) == want


def test_lm_without_training_documents(spark):
    found = lattice_lm.lm_scores(odd(spark), F.lit(False), vocabulary("piece_bpe_32k.model")).collect()
    assert len(found) == len(ODD) and all(r["base_score"] == 0 and r["score"] < 0 and r["train_tokens"] == r["n_known"] == 0 for r in found)
    assert lattice_lm.lm_scores(odd(spark).limit(0), F.lit(True), vocabulary("piece_bpe_32k.model")).count() == 0


def test_lm_counts(spark, docs):
    train = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i in docs}
    split = {i: words("".join(c.lower() if c.isascii() else c for c in t)) for i, t in docs.items()}
    c = collections.Counter(w for i in docs if train[i] for w in split[i])
    ends = sum(train.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    base = lambda x: np.log10((x + 0.5) / (n + 0.5 * (v + 1)))
    for r in entry.queries()["op4_lattice_lm"](spark, SF).collect():
        w = split[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[r["doc_id"]], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert np.isclose(r["base_score"], sum(base(c[x]) for x in w) + base(ends)) and r["score"] < 0
    odd_rows = lattice_lm.lm_scores(odd(spark), fold("doc_id") != 1, vocabulary("piece_bpe_32k.model")).collect()
    assert len(odd_rows) == len(ODD) and all(np.isfinite(r["score"]) for r in odd_rows)


def test_repetition(spark, docs):
    for r in repetition.repetition(read_table(spark, SF, "documents")).collect():
        t, w = docs[r["doc_id"]], words(docs[r["doc_id"]])
        places, covered = [collections.defaultdict(list) for _ in range(2)], []
        for size, seen in zip((3, repetition.MIN_WORDS), places):
            for j in range(len(w) - size + 1):
                seen[tuple(w[j : j + size])].append(j)
            covered.append({k for v in seen.values() if len(v) > 1 for j in v for k in range(j, j + size)})
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered[0]))
        assert r["covered_words"] == len(covered[1]) == sum(s["end"] - s["start"] for s in r["repeat_spans"])
    assert repetition.repetition(odd(spark)).count() == len(ODD) and repetition.repetition(odd(spark).limit(0)).count() == 0


def plain_repeats(w):
    """(start, length) of the longest repeat of MIN_WORDS or more from each position, by comparing all pairs."""
    found = {}
    for i in range(len(w)):
        for j in range(i):
            n = 0
            while i + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            if n >= repetition.MIN_WORDS:
                found[i], found[j] = max(n, found.get(i, 0)), max(n, found.get(j, 0))
    return found


def test_verdicts_against_all_pairs(spark, docs):
    rng = np.random.default_rng(9)
    phrases = [" ".join(rng.choice(list("abcdefghij"), n)) for n in (5, 12, 30, 61, 70)]
    made = {10_000 + k: " ".join(str(rng.choice(phrases)) if rng.random() < 0.4 else " ".join(f"w{x}" for x in rng.integers(0, 900, 25)) for _ in range(rng.integers(1, 14))) for k in range(80)}
    texts = {i: t for i, t in docs.items() if len(t) < 4000} | made | {1: None, 2: "", 3: "z " * 70}
    verdicts = collections.Counter()
    for r in repetition.repetition(odd(spark, list(texts.items()))).collect():
        w = words(texts[r["doc_id"]])
        spans = plain_repeats(w)
        covered = {k for a, n in spans.items() for k in range(a, a + n)}
        three = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        kept = not failed and len(covered) <= 0.25 * len(w) and max(spans.values(), default=0) <= 60
        assert (r["covered_words"], r["longest_repeat"], r["base_failed"], r["kept"]) == (len(covered), max(spans.values(), default=0), failed, kept)
        verdicts[failed, kept, len(covered) > 0.25 * len(w), r["longest_repeat"] > 60] += 1
    assert {(False, True, False, False), (False, False, True, False), (False, False, True, True)} <= set(verdicts)


def test_longest_repeat():
    text = " ".join([*map(str, range(30)), "x", *map(str, range(30)), "y"] + ["z"] * 25).encode()
    n, *_, covered, longest, spans = repetition.measures([text, text, b""])[0]
    assert (covered, longest) == (85, 30) and [(s["start"], s["end"]) for s in spans] == [(0, 30), (31, 61), (62, 87)]


def test_licenses(spark):
    mit = licenses.TEMPLATES[4][1]
    rows = [(1, "Prose.\nReleased under the MIT License.\nMore."), (2, mit), (3, mit.replace(". ", ".\n")), (4, "The license of the sea is free."), (5, None), (6, "")]
    found = {(r["doc_id"], r["license"], r["first_line"]) for r in licenses.license_scan(odd(spark, rows)).collect()}
    assert found == {(1, "MIT", 1), (2, "MIT", 0), (3, "MIT", 0)}
    assert licenses.license_scan(odd(spark).limit(0)).count() == 0
    twice = [(9, mit), (9, mit), (None, LONG + "\n\n" + mit + "\n" + LONG), (10, mit + "\n\n" + mit)]
    again = sorted((str(r["doc_id"]), r["license"], r["first_line"]) for r in licenses.license_scan(odd(spark, twice)).collect())
    assert again == [("10", "MIT", 0), ("9", "MIT", 0), ("9", "MIT", 0), ("None", "MIT", 2)]


def test_mixing(spark):
    docs = read_table(spark, SF, "documents").withColumn("t", mixing.tokens_of())
    total = docs.agg({"t": "sum"}).first()[0]
    found = mixing.mix(docs, ["doc_id", "lang", "source", "t", mixing.domain_of().alias("domain")], mixing.domain_of(), epochs=2).collect()
    got = sum(r["t"] for r in found)
    assert 0.5 * 0.8 * total < got <= 0.8 * total
    assert max(collections.Counter(r["doc_id"] for r in found).values()) <= 2
    everything = mixing.mix(docs, ["doc_id"], mixing.domain_of(), share=1.0, epochs=1)
    assert everything.count() == docs.count()
    assert mixing.mix(odd(spark), ["doc_id"], mixing.domain_of(), share=1.0, epochs=1).count() == len(ODD)
    assert mixing.mix(odd(spark).limit(0), ["doc_id"], mixing.domain_of()).count() == 0


def test_shares_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 90), ("d0", "de", "c", 20), ("d1", "en", "e", 200)], "_domain string, _lang string, _source string, held long")
    got = {r["_source"]: r["quota"] for r in mixing.plan(leaves, 0.5, 1, {"d0": 1.0, "d1": 1.0}, {"en": 1.0, "de": 1.0}).collect()}
    assert got == {"a": 10, "b": 50, "c": 20, "e": 80}


def test_pipeline(spark):
    found = corpus_pipeline.run(spark, SF)
    rows = found.collect()
    assert rows and len({r["doc_id"] for r in rows}) < 200
    docs = read_table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
