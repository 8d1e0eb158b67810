"""Stores: what is written, durable, read and refused."""

import pytest

from loomstate.operators import store


def frames(spark, durable=(10, 20, 5), waiting=(7, 8)):
    at, rows = 0, []
    for k, size in enumerate((*durable, *waiting)):
        rows.append((1, k, size, at, at + size, k < len(durable)))
        at += size
    return spark.createDataFrame(rows, "execution_id long, seq long, size long, offset long, end_pos long, durable boolean")


def at(spark, *positions):
    return spark.createDataFrame([(1, p) for p in positions], "execution_id long, position long")


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


def test_append_and_commit(spark):
    f = store.append(frames(spark), spark.createDataFrame([(1, 9, 3), (1, 5, 4), (2, 0, 6)], "execution_id long, seq long, size long"))
    assert sorted((r["execution_id"], r["seq"], r["offset"], r["durable"]) for r in f.collect() if not r["durable"]) == [(1, 3, 35, False), (1, 4, 42, False), (1, 5, 50, False), (1, 9, 54, False), (2, 0, 0, False)]
    assert sorted(map(tuple, store.ends(f).collect())) == [(1, 57, 35), (2, 6, 0)]
    done = store.commit_prefix(f, at(spark, 42))
    assert seqs(done.where("durable")) == [0, 1, 2, 3] and done.count() == 8
    assert seqs(store.commit_prefix(f, at(spark, 10)).where("durable")) == [0, 1, 2]
    assert store.commit_all(f).where("durable").count() == 8 and seqs(store.rolled_back(f)) == [0, 1, 2]


def test_reading_and_truncating(spark):
    f = frames(spark)
    assert seqs(store.read_from(f, at(spark, 0))) == [0, 1, 2] and seqs(store.read_from(f, at(spark, 10))) == [1, 2] and seqs(store.read_from(f, at(spark, 35))) == []
    assert seqs(store.truncate_to(f, at(spark, 30))) == [0, 1] and seqs(store.truncate_to(f, at(spark, 0))) == []
    assert seqs(store.truncate_to(f, spark.createDataFrame([(2, 0)], "execution_id long, position long"))) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("action, f, position, why", [
    ("commit", store.commit_prefix, 51, "beyond the written end"), ("commit", store.commit_prefix, 11, "inside a frame"),
    ("read", store.read_from, 42, "beyond the durable end"), ("read", store.read_from, 9, "inside a frame"), ("truncate", store.truncate_to, 29, "inside a frame"),
])
def test_refusals(spark, action, f, position, why):
    with pytest.raises(Exception, match=why):
        f(frames(spark), at(spark, position)).collect()
    assert [tuple(r) for r in store.refused(frames(spark), at(spark, position), action).collect()] == [(1, position, why)]
    assert store.refused(frames(spark), at(spark, 0), action).count() == 0


def test_files(spark, tmp_path):
    """A store that is opened has what was durable; making it anew drops that, extending it doesn't, nor does it add a frame twice."""
    path = str(tmp_path / "store")
    store.create(frames(spark), path)
    assert seqs(store.open_store(spark, path)) == [0, 1, 2]
    more = store.commit_all(frames(spark))
    store.extend(more, path)
    store.extend(more, path)
    assert seqs(store.open_store(spark, path)) == [0, 1, 2, 3, 4] and [tuple(r) for r in store.ends(store.open_store(spark, path)).collect()] == [(1, 50, 50)]
    store.create(frames(spark, durable=(4,), waiting=()), path)
    assert seqs(store.open_store(spark, path)) == [0]
