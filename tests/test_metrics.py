"""Hand-computed rankings."""

import math

import pytest

from sparkvec.operators import metrics as M

RUN = "method string, k int, q_idx bigint, doc_idx bigint, rank int, score double"
REL = "q_idx bigint, doc_idx bigint"


def _run(spark, rankings, method="m", k=1):
    return spark.createDataFrame(
        [(method, k, q, d, i + 1, 1.0 / (i + 1)) for q, docs in rankings.items() for i, d in enumerate(docs)], RUN)


def test_three_queries(spark):
    # query 0: both relevant at ranks 1 and 3; query 1: at rank 2 of 1; query 2: nothing found; query 3 unranked
    run = _run(spark, {0: [10, 11, 12], 1: [13, 14], 2: [10, 11]})
    rel = spark.createDataFrame([(0, 10), (0, 12), (1, 14), (2, 14), (3, 10)], REL)
    m = M.ranking_metrics(run, rel).first()
    assert m["recall_at_1"] == pytest.approx(1 / 5)
    assert m["recall_at_5"] == pytest.approx(3 / 5)
    assert m["hit_rate_at_1"] == pytest.approx(1 / 4)
    assert m["hit_rate_at_5"] == pytest.approx(2 / 4)
    assert m["mrr"] == pytest.approx((1 + 0.5) / 4)
    ideal = 1 + 1 / math.log2(3)
    assert m["ndcg_at_10"] == pytest.approx(((1 + 0.5) / ideal + 1 / math.log2(3)) / 4)


def test_method_without_hits_is_zero(spark):
    rel = spark.createDataFrame([(0, 99)], REL)
    m = M.ranking_metrics(_run(spark, {0: [1, 2], 7: [99]}), rel).collect()
    assert len(m) == 1 and m[0]["recall_at_100"] == 0 and m[0]["mrr"] == 0 and m[0]["ndcg_at_10"] == 0


def test_no_judgments(spark):
    m = M.ranking_metrics(_run(spark, {0: [1]}), spark.createDataFrame([], REL)).first()
    assert m["mrr"] is None and m["ndcg_at_10"] is None and m["hit_rate_at_1"] == 0 and m["recall_at_1"] == 0


def test_recall_grows_with_the_cut(spark):
    run = _run(spark, {q: list(range(q, q + 40)) for q in range(6)})
    rel = spark.createDataFrame([(q, d) for q in range(6) for d in (q + 2, q + 7, q + 30)], REL)
    m = M.ranking_metrics(run, rel).first()
    values = [m[f"recall_at_{c}"] for c in M.CUTS]
    assert values == sorted(values) and values[-1] == 1.0


def test_matched_k_prefers_the_smaller(spark):
    rows = [("s", 32, "ndcg_at_10", 0.5), ("s", 16, "ndcg_at_10", 0.5), ("s", 64, "ndcg_at_10", 0.4)]
    long = spark.createDataFrame(rows, "method string, k int, metric string, value double")
    assert M.matched_k(long, "best").first()["k"] == 16
    assert {r["k"] for r in M.matched_k(long, "all").collect()} == {16, 32, 64}
    assert [r["k"] for r in M.matched_k(long, "primary", primary=32).collect()] == [32]
    with pytest.raises(Exception, match="no metric"):
        M.matched_k(long, "best", "recall_at_1").collect()


def test_retention(spark):
    rows = [("dense", 0, "mrr", 0.5), ("sparse", 8, "mrr", 0.4), ("dense", 0, "ndcg_at_10", 0.0), ("sparse", 8, "ndcg_at_10", 0.0)]
    long = spark.createDataFrame(rows, "method string, k int, metric string, value double")
    got = {r["metric"]: r["retention"] for r in M.retention(long).collect()}
    assert got["mrr"] == pytest.approx(0.8) and got["ndcg_at_10"] == 0


def test_trec_line(spark):
    run = spark.createDataFrame([("q1", "d7", 3, 0.25)], "qid string, did string, rank int, score double")
    assert M.trec_lines(run, "tag").first()["line"] == "q1 Q0 d7 3 0.333333 tag"
    assert M.trec_lines(run, "tag", real_score=True).first()["line"] == "q1 Q0 d7 3 0.250000 tag"


def test_activity(spark):
    seen = spark.createDataFrame([(0, 1), (4, 1), (2, 0)], "step int, feature_id int")
    gaps = {r["feature_id"]: r["gap"] for r in M.steps_since_active(seen, 6, 4).collect()}
    assert gaps == {0: 3, 1: 1, 2: 6, 3: 6}
    assert M.dead_fraction(M.steps_since_active(seen, 6, 4), 3).first()[0] == 0.5
