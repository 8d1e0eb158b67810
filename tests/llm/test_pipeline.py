"""The pipeline's stages, alone and one after the other, and op6's rows, against plain Python."""

import collections
import hashlib
import math
import zlib

from test_llm import SF, brute_links

import __spark_entry__ as entry
import corpus_pipeline
from loomstate.llm import licenses, line_crf, mixing
from loomstate.llm.common import read_table


def share_out(nodes, budget):
    """nodes: name -> (cap, weight). The budget by weights, none above its cap, what's left over to the others."""
    got, left = {}, dict(nodes)
    while left:
        level = budget / sum(w for _, w in left.values())
        full = [n for n, (cap, w) in left.items() if cap <= level * w]
        if not full:
            return got | {n: level * w for n, (_, w) in left.items()}
        for n in full:
            got[n] = left.pop(n)[0]
            budget -= got[n]
    return got


def plain_mix(rows, share=0.9):
    leaves = collections.defaultdict(list)
    for r in rows:
        source = r["source"] or ""
        leaf = (f"d{zlib.crc32(source.encode()) % 4}", r["lang"] or "", source)
        leaves[leaf].append((max(1, -(-len((r["text"] or "").encode()) // 4)), r["doc_id"]))
    held = {leaf: sum(t for t, _ in x) for leaf, x in leaves.items()}
    under = lambda *top: {leaf for leaf in leaves if leaf[: len(top)] == top}
    cap = lambda *top: sum(held[leaf] for leaf in under(*top))
    kept = set()
    for d, of_d in share_out({d: (cap(d), mixing.DOMAIN_WEIGHTS.get(d, 1)) for d, *_ in leaves}, math.floor(cap() * share)).items():
        for n, of_n in share_out({n: (cap(d, n), mixing.LANG_WEIGHTS.get(n, 1)) for _, n, _ in under(d)}, of_d).items():
            for s, of_s in share_out({s: (cap(d, n, s), 1) for *_, s in under(d, n)}, of_n).items():
                quota = math.floor(of_s + 1e-6)
                whole = min(quota // held[d, n, s], 1)
                rest, reach = quota - whole * held[d, n, s], 0
                order = lambda x: (int(hashlib.md5(f"{mixing.SEED}:{whole}:{x[1]}".encode()).hexdigest()[:15], 16), x[1])  # noqa: B023, E731
                for t, i in sorted(leaves[d, n, s], key=order):
                    reach += t
                    if whole or reach <= rest:
                        kept.add(i)
    return kept


def plain_exact(rows):
    low = {}
    for r in rows:
        low[r["text"] or ""] = min(low.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    return set(low.values())


def plain_near(rows):
    return {i for i, (_, low) in brute_links({r["doc_id"]: r["text"] or "" for r in rows}, 5, 80).items() if i == low}


def test_stages_against_plain_python(spark):
    docs = read_table(spark, SF, "documents")
    score = {r["doc_id"]: r["score"] for r in line_crf.scored(docs, read_table(spark, SF, "labels"), ["doc_id"]).collect()}
    good = lambda rows: {r["doc_id"] for r in rows if score[r["doc_id"]] >= line_crf.THRESHOLD}
    plain = {"quality": good, "exact_dedup": plain_exact, "near_dedup": plain_near, "mixing": plain_mix}
    whole = docs.collect()
    rows, told = whole, {r["doc_id"]: r for r in whole}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (whole, rows):  # the stage by itself, and behind the others
            found = stage(spark, spark.createDataFrame(given, docs.schema), SF).collect()
            ids = [r["doc_id"] for r in found]
            assert sorted(ids) == sorted(plain[name](given)) and all(r == told[r["doc_id"]] for r in found), name
        rows = found
    assert 0 < len(rows) < len(whole)
    pieces = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    assert set(pieces) == {r["doc_id"] for r in rows}
    for x in pieces.values():
        x.sort()
        assert [s for s, *_ in x] == [sum(n for _, n, _ in x[:k]) for k in range(len(x))] and sum(n for _, n, _ in x) == x[0][2]


def plain_licences(text):
    """All spans of all templates; of those with common words the one that explains most."""
    words, line = [], []
    for k, x in enumerate(text.split("\n")):
        found = licenses.normalised_words(x)
        words += found
        line += [k] * len(found)
    grams, spans = list(zip(words, words[1:])), []
    for name, template in licenses.TEMPLATES:
        of = licenses.bigrams(licenses.normalised_words(template))
        at = [p for p, g in enumerate(grams) if g in of]
        if 1.5 * len(of & set(grams)) < len(of) - 0.001:
            continue
        for a in at:
            for b in (b for b in at if a <= b <= a + 3 * len(of)):
                unit = set(grams[a : b + 1])
                n = len(unit & of)
                if (dice := 2 * n / (len(unit) + len(of))) >= licenses.THRESHOLD:
                    spans.append((2 * n - len(unit), dice, a - b, -a, name))
    rows, taken = {}, []
    for rank, dice, length, a, name in sorted(spans, reverse=True):
        span = (-a, -a - length)
        if all(span[0] > y + 1 or span[1] + 1 < x for x, y in taken):
            taken.append(span)
            rows[name] = max(rows.get(name, (0,)), (dice, length, a))
    return {(name, dice, line[-a], line[1 - a - n]) for name, (dice, n, a) in rows.items()}


def test_licences_of_all_documents(spark):
    told = {(r["doc_id"], *row) for r in read_table(spark, SF, "documents").collect() for row in plain_licences(r["text"] or "")}
    assert told and {tuple(r) for r in entry.queries()["op6_licenses"](spark, SF).collect()} == told
