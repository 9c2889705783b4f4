"""The stored index under updates, reruns, compaction and crashes between its steps."""

import random

import pytest

from sparkvec.functions import vector as V
from sparkvec.operators.search import build_index, index_stats, sparse_search
from sparkvec.session import child_names, remove
from sparkvec.sources import index_store as I

SCHEMA = f"doc_idx bigint, code {V.CODE_TYPE}"


def frame(spark, state):
    return spark.createDataFrame(sorted(state.items()), SCHEMA)


def same(spark, path, state):
    """Documents, scan, lookup and both kinds of statistics equal those of a fresh index."""
    state = {d: c for d, c in state.items() if c is not None}
    index, fresh = I.read_index(spark, path), build_index(frame(spark, state))
    assert {r["doc_idx"]: [tuple(e) for e in r["code"]] for r in index.docs.collect()} == state
    queries = spark.createDataFrame([(0, [(1, 1.0), (2, -0.5)]), (1, [(3, 2.0)])], f"q_idx bigint, code {V.CODE_TYPE}")
    want = sorted(map(tuple, sparse_search(queries, fresh.docs, 50).collect()))
    rows = lambda hits: sorted((*h[:3], round(h[3], 9)) for h in hits.collect())
    assert rows(index.search(queries, 50, backend="postings")) == rows(index.search(queries, 50)) == [(*w[:3], round(w[3], 9)) for w in want]
    assert rows(index.search(queries, 3, backend="bounded")) == rows(sparse_search(queries, fresh.docs, 3))
    stats = I.stored_index_stats(spark, path).first()
    assert stats == index_stats(fresh).first() == index_stats(index).first()


def code(r):
    return [(f, round(r.choice([-1, 1]) * r.random(), 3)) for f in r.sample(range(6), r.randrange(1, 4))]


def batches(r, n):
    return [{r.randrange(30): None if r.random() < 0.25 else [(f, w) for f, w in code(r)] for _ in range(12)} for _ in range(n)]


def single(state):
    """Weights as the stored floats."""
    import numpy as np
    return {d: None if c is None else [(f, float(np.float32(w))) for f, w in c] for d, c in state.items()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_updates_and_compaction(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(I, "TOUCHED_BROADCAST", 0)
    r, path = random.Random(5), str(tmp_path)
    state = single({d: code(r) for d in range(20)})
    I.write_index(build_index(frame(spark, state)), path)
    for v, change in enumerate(map(single, batches(r, 4))):
        I.write_segment(frame(spark, change), path, v)
        if v == 1:
            I.write_segment(frame(spark, change), path, v)  # a batch that is run again
        state |= change
        if v == 2:
            same(spark, path, state)
            assert I.compact_index(spark, path) == 2
    same(spark, path, state)
    assert I.versions(spark, path) == (2, [3])
    I.vacuum_index(spark, path)
    assert child_names(spark, f"{path}/docs") == ["base=2", "segment=3"]
    same(spark, path, state)


def test_crashes_change_nothing(spark, tmp_path):
    r, path = random.Random(6), str(tmp_path)
    state = single({d: code(r) for d in range(9)})
    I.write_index(build_index(frame(spark, state)), path)
    change = single(batches(r, 1)[0])
    I.write_segment(frame(spark, change), path, 0)
    remove(spark, f"{path}/log/segment=0")  # stopped before the batch was whole
    same(spark, path, state)
    I.write_segment(frame(spark, change), path, 0)
    state |= change
    I.compact_index(spark, path)
    remove(spark, f"{path}/log/base=0")  # stopped before the new base counted
    remove(spark, f"{path}/postings/base=0")
    same(spark, path, state)
    I.compact_index(spark, path)
    remove(spark, f"{path}/log/segment=0")  # stopped within the vacuum
    same(spark, path, state)
    I.write_segment(frame(spark, change), path, 0)  # a batch replayed after it was merged
    same(spark, path, state)


def test_odd_rows_and_empty_index(spark, tmp_path):
    path = str(tmp_path)
    assert I.versions(spark, path) == (None, []) and I.read_index(spark, path).docs.count() == 0
    assert I.stored_index_stats(spark, path).first()["num_docs"] == 0
    rows = [(1, [(1, 0.5)]), (1, [(1, 0.25)]), (1, None), (2, None), (None, [(1, 1.0)]), (3, [])]
    I.write_segment(spark.createDataFrame(rows, SCHEMA), path, 0)
    same(spark, path, {1: [(1, 0.5)], 3: []})
    I.write_segment(spark.createDataFrame([], SCHEMA), path, 1)
    I.compact_index(spark, path)
    same(spark, path, {1: [(1, 0.5)], 3: []})
