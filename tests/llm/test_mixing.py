"""Target weights of sources."""

import collections

import pytest
from pyspark.sql import functions as F

from loomstate.llm import mixing

LEAF = "_domain string, _lang string, _source string, held long"


def test_sources_share_by_their_weights(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 400), ("d0", "en", "b", 400), ("d0", "en", "c", 30), ("d0", "en", "e", 400)], LEAF)
    plan = lambda weights: {r["_source"]: r["quota"] for r in mixing.plan(leaves, 0.5, 1, {}, {}, weights).collect()}
    assert plan({"a": 3.0, "c": 9.0}) == {"a": 351, "b": 117, "c": 30, "e": 117}  # c is used up; a, b and e share what's left 3:1:1
    assert plan({}) == {"a": 195, "b": 195, "c": 30, "e": 195}
    with pytest.raises(ValueError):
        plan({"a": 0.0})


def test_a_mix_meets_the_weights_of_sources(spark):
    docs = spark.createDataFrame([(i, "abcd", "en", "ab"[i % 2], 4) for i in range(1000)], "doc_id long, text string, lang string, source string, n_chars long")
    one = F.lit("d0")
    count = lambda df: dict(collections.Counter(r["source"] for r in df.collect()))
    assert count(mixing.mix(docs, ["doc_id", "source"], one, share=0.5, epochs=1, source_weights={"a": 4.0})) == {"a": 400, "b": 100}
    assert count(mixing.keep_mix(docs.withColumn("source", F.lit("s")).limit(10), source_weights={"s": 2.0})) == {"s": 9}
