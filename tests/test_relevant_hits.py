"""Hits joined to judgments: the run, which is the large side, never passes through the driver."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import oracle
from sparkvec.catalog import ORACLES, QUERIES
from sparkvec.operators import metrics as M


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(4)
    pq.write_table(pa.table({"vec_id": np.arange(240), "embedding": list(rng.normal(size=(240, 64)).astype(np.float32)),
                             "label": np.arange(240, dtype=np.int32) % 7}), folder / "embeddings.parquet")
    orders, parts, numbers = (rng.integers(a, b, 9000).tolist() for a, b in ((0, 400), (0, 400), (1, 8)))
    pq.write_table(pa.table({
        "l_orderkey": pa.array([*orders, *orders[:50], None, 5, 5], pa.int64()),
        "l_partkey": pa.array([*parts, *parts[:50], 3, None, 3], pa.int64()),
        "l_linenumber": pa.array([*numbers, *numbers[:50], 4, 4, None], pa.int32())}), folder / "lineitem.parquet")
    return str(folder)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _broadcasts_a_run(plan):
    """Whether a search lies below a broadcast."""
    above = []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, x) for d, x in above if d < depth]
        if "MapInArrow" in line and any("BroadcastExchange" in x for _, x in above):
            return True
        above.append((depth, line))
    return False


@pytest.mark.parametrize("name", ("J14_hits", "W2_first_relevant"))
def test_hits_are_not_broadcast(spark, tables, name):
    found = QUERIES[name](spark, tables)
    assert "MapInArrow" in _plan(found) and not _broadcasts_a_run(_plan(found))
    want = oracle.connect(tables).execute(ORACLES[name]).df()
    assert len(want) > 200 and oracle.difference(found.toPandas(), want) is None


def test_many_judgments_meet_the_run_in_a_shuffle(spark):
    run = spark.createDataFrame([(q, d, r) for q in range(30) for r, d in enumerate(range(q, q + 20), 1)], "q_idx bigint, doc_idx bigint, rank int")
    judged = [(q, q + 3) for q in range(0, 60, 2)] + [(1, 4), (1, 4), (None, 4), (2, None)]
    relevance = spark.createDataFrame(judged, "q_idx bigint, doc_idx bigint")
    few, many = M.relevant_hits(run, relevance, len(judged)), M.relevant_hits(run, relevance, len(judged) - 1)
    assert "BuildRight" in _plan(few) and "BroadcastExchange" not in _plan(many)
    want = sorted([(q, q + 3, 4) for q in range(0, 30, 2)] + [(1, 4, 4)] * 2)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == want
    assert M.relevant_hits(run, relevance.where("false")).isEmpty()
