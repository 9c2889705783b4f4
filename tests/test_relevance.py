"""Sampling guarantees and splits."""

import pytest
from pyspark.sql import functions as F

from sparkvec.operators import relevance as R

PAIR = "q_idx bigint, doc_idx bigint"


def _by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["q_idx"], []).append((r["pick"], r["doc_idx"]))
    return {q: [d for _, d in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("n_docs,n", [(1000, 7), (30, 20), (12, 50)])
def test_negatives(spark, n_docs, n):
    pos_rows = [(q, (q * 3 + j) % n_docs) for q in range(8) for j in range(q + 1)]
    neg_rows = [(q, (q * 5 + j + 11) % n_docs) for q in range(0, 8, 2) for j in range(4)]
    neg_rows = [r for r in neg_rows if r not in pos_rows]
    pos, neg = spark.createDataFrame(pos_rows, PAIR), spark.createDataFrame(sorted(set(neg_rows)), PAIR)
    got = _by_query(R.sample_negatives(pos, neg, n_docs, n, 3))
    for q in range(8):
        positives = {d for p, d in pos_rows if p == q}
        listed = {d for p, d in neg_rows if p == q}
        want = min(n, n_docs - len(positives))
        picked = got.get(q, [])
        assert len(picked) == want == len(set(picked))
        assert not positives & set(picked) and all(0 <= d < n_docs for d in picked)
        first = min(len(listed), want)
        assert set(picked[:first]) <= listed and len(set(picked[:first])) == first
    assert got == _by_query(R.sample_negatives(pos.repartition(5), neg.repartition(3), n_docs, n, 3))


def test_one_query_owning_most_judgments(spark):
    """A query whose positives cover nearly the whole pool still gets exactly what is left."""
    pos = spark.range(5000).where("id % 1000 <> 7").select(F.lit(0).cast("bigint").alias("q_idx"), F.col("id").alias("doc_idx"))
    pos = pos.unionByName(spark.createDataFrame([(1, 3)], PAIR))
    got = _by_query(R.sample_negatives(pos, spark.createDataFrame([], PAIR), 5000, 4, 1))
    assert len(got[0]) == 4 and all(d % 1000 == 7 for d in got[0])
    assert len(got[1]) == 4


def test_triplets(spark):
    pairs = spark.range(40).withColumnRenamed("id", "row_idx")
    loose = R.sample_triplets(pairs, 40, 30, 5).collect()
    sizes = {}
    for r in loose:
        assert r["neg_idx"] != r["row_idx"]
        assert r["query_side"] == ("text" if r["row_idx"] % 2 == 0 else "image") != r["negative_side"]
        sizes[r["row_idx"]] = sizes.get(r["row_idx"], 0) + 1
    assert set(sizes.values()) == {29, 30}
    exact = R.sample_triplets(pairs, 40, 30, 5, "text", exact=True)
    assert {r["count"] for r in exact.groupBy("row_idx").count().collect()} == {30}
    with pytest.raises(ValueError):
        R.sample_triplets(pairs, 40, 41, 5)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 57])
def test_split_partitions_the_queries(spark, n):
    q = spark.range(n).withColumnRenamed("id", "q_idx")
    train, val = (set(r[0] for r in R.retrieval_split(q, n, 0.1, 9, s).collect()) for s in ("train", "val"))
    assert train | val == set(range(n)) and not train & val
    assert len(val) == (0 if n <= 1 else min(max(round(n * 0.1), 1), n - 1))
    with pytest.raises(ValueError):
        R.retrieval_split(q, n, 0.1, 9, "dev")


def test_seeded_sample(spark):
    rows = spark.range(300).withColumnRenamed("id", "row_idx")
    a = {r[0] for r in R.seeded_sample(rows, 300, 40, 1).collect()}
    assert len(a) == 40 and a == {r[0] for r in R.seeded_sample(rows.repartition(7), 300, 40, 1).collect()}
    assert a != {r[0] for r in R.seeded_sample(rows, 300, 40, 2).collect()}
    assert R.seeded_sample(rows, 300, 400, 1).count() == 300


def test_relevance_needs_both_sides(spark):
    items = "row_idx bigint, item_id string"
    q = spark.createDataFrame([(0, "a"), (1, "b")], items)
    d = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], items)
    qrels = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "nope"), ("zz", "y")], "qid string, did string")
    assert [tuple(r) for r in R.relevance_rows(qrels, q, d).collect()] == [(0, 2)]  # the last x wins
    assert [r["row_idx"] for r in R.judged_queries(q, R.relevance_rows(qrels, q, d)).collect()] == [0]
    with pytest.raises(ValueError, match="none"):
        R.require_rows(R.relevance_rows(qrels.where("qid = 'b'"), q, d), "none")


def test_paired_split(spark):
    rows = spark.range(25).withColumnRenamed("id", "row_idx")
    assert sorted(r[0] for r in R.paired_split(rows, 25, 0.1, "val").collect()) == [23, 24]
    assert R.paired_split(rows, 25, 0.1, "train").count() == 23


def test_draws_are_about_as_many_as_are_taken(spark, monkeypatch):
    """The smallest draw numbers win, so a first round of few draws gives the same rows as one of many."""
    from hashlib import md5
    seen, cut = [], R.first_per_group
    monkeypatch.setattr(R, "first_per_group", lambda df, *a: seen.append(df.count()) or cut(df, *a))
    need = spark.createDataFrame([(1, 300), (2, 300)], "q_idx bigint, need int")
    used = spark.createDataFrame([(1, d) for d in range(1000)] + [(3, 1), (None, 2)], "q_idx bigint, doc_idx bigint")
    got = {(q, d): r for q, d, r in R._draw_distinct(need, used, 5000, 300, 7).select("q_idx", "doc_idx", "_r").collect()}
    want = {}
    for q, taken in ((1, 1000), (2, 0)):
        drawn = [int(md5(f"7:draw:{q}:{i}".encode()).hexdigest()[:15], 16) % 5000 for i in range(1200)]
        picked = list(dict.fromkeys(d for d in drawn if d >= taken))[:300]
        want |= {(q, d): r for r, d in enumerate(picked, 1)}
    assert got == want
    assert seen[0] < 2 * 450


def test_small_pools_travel_to_the_judgments(spark):
    qrels = spark.createDataFrame([("1", "2", 1.0), ("1", "9", 1.0), ("2", "1", 0.0), ("2", "2", 2.0), ("2", "2", 1.0), (None, "1", 1.0)],
                                  "qid string, did string, rel double")
    items = spark.createDataFrame([(1, "1"), (2, "2"), (3, "2"), (4, None)], "row_idx bigint, item_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans, rows = [], []
        for size in (R.POOL_BYTES, 0):
            made = R.relevance_rows(qrels, items, items, size)
            plans.append(made._jdf.queryExecution().executedPlan().toString())
            rows.append(sorted(map(tuple, made.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans[0].count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plans[0]
    assert "BroadcastHashJoin" not in plans[1]
    assert rows[0] == rows[1] == [(1, 3), (2, 3), (3, 3)]


def test_judgments_are_read_once_for_the_metrics(spark, sf_dir):
    from sparkvec.catalog import QUERIES
    for name in ("M4_ndcg", "M1_macro_recall", "M12_raw_topk_suite"):
        assert "l_orderkey" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
