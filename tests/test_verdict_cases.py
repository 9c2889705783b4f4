"""Cases that small tables don't show."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.functions.hashing import hash_int
from sparkvec.operators import coding as C
from sparkvec.operators import metrics as M
from sparkvec.operators import relevance as R
from sparkvec.plans import suites
from sparkvec.sources import dense as D
from sparkvec.sources import stores


def test_draws_reach_every_row_of_a_large_pool(spark):
    need = spark.range(200).select(F.col("id").alias("q_idx"), F.lit(3).alias("need"))
    used = spark.createDataFrame([], "q_idx bigint, doc_idx bigint")
    pool = 1 << 40
    got = [r["doc_idx"] for r in R._draw_distinct(need, used, pool, 3, 1).collect()]
    assert len(got) == 600 and max(got) > pool * 0.95 and sum(x > 1 << 32 for x in got) > 590
    assert spark.range(100).agg(F.max(hash_int(0, "id"))).first()[0] > 1 << 58


def test_only_used_weights_are_shipped():
    coder = C.SparseCoder(np.zeros((32_768, 2048), np.float32), np.zeros(32_768, np.float32), np.zeros((32_768, 2048), np.float32),
                          np.zeros(2048, np.float32), 128)
    limit = C.BROADCAST_BYTES
    assert C._coder_bytes(coder) > limit
    assert C._coder_bytes(C._encoder_part(coder)) <= limit and C._coder_bytes(C._decoder_part(coder)) <= limit


def test_erf_is_that_of_the_library():
    x = np.concatenate([np.linspace(-7, 7, 20_001), [0.0, 2.5, -2.5, 40.0, -1e3]])
    assert np.abs(C.erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-14


def test_k_over_the_dictionary_is_clamped(spark):
    coder = C.SparseCoder(np.eye(4, dtype=np.float32), np.zeros(4, np.float32), None, None, 2, model_type="encoder_only")
    assert suites.sweep_ks([2, 100, 8], coder) == [2, 4] and suites.sweep_ks([2, 100], coder, within=True) == [2]
    with pytest.raises(ValueError):
        suites.sweep_ks([100], coder, within=True)


def test_an_empty_run_scores_zero(spark):
    run = spark.createDataFrame([("a", 1, 0, 0, 1, 0.5)], "method string, k int, q_idx bigint, doc_idx bigint, rank int, score double")
    rel = spark.createDataFrame([(0, 0), (1, 5)], "q_idx bigint, doc_idx bigint")
    got = {(r["method"], r["k"]): r for r in M.ranking_metrics(run, rel, [("a", 1), ("b", 2)]).collect()}
    assert got[("b", 2)]["recall_at_10"] == got[("b", 2)]["mrr"] == got[("b", 2)]["ndcg_at_10"] == 0
    assert got[("a", 1)]["mrr"] == 0.5


def test_the_matching_metric_must_be_there_at_every_k(spark):
    rows = [("sparse", 8, "mrr", 0.5), ("sparse", 16, "mrr", 0.7)]
    schema = "method string, k int, metric string, value double"
    assert M.matched_k(spark.createDataFrame(rows, schema), "best", "mrr").first()[0] == 16
    with pytest.raises(Exception, match="at some k"):
        M.matched_k(spark.createDataFrame(rows + [("sparse", 32, "other", 1.0)], schema), "best", "mrr").collect()


def test_primary_k_is_the_first_one_asked_for(spark):
    import json
    values = spark.createDataFrame([("sparse", 16, "mrr", 0.0), ("sparse", 64, "mrr", 0.0), ("dense", 0, "mrr", 0.0)],
                                   "method string, k int, metric string, value double")
    times = spark.createDataFrame([], "method string, k int, stage string, seconds double")
    body = json.loads(stores.report(values, times, primary_k=64).first()[0])
    assert {m["method"]: m["primary_k"] for m in body["methods"]} == {"sparse": 64, "dense": 0}


def test_identity_pca_keeps_the_mean(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, 5.0 - i]) for i in range(5)], "row_idx bigint, embedding array<float>")
    m = C.pca_fit(df, 8)
    assert m.method == "identity" and np.allclose(m.mean, [2, 1, 3])


def test_cache_is_not_valid_while_it_is_rewritten(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"d{i}", [1.0, float(i)]) for i in range(4)], "row_idx bigint, item_id string, embedding array<float>")
    path = str(tmp_path / "cache")
    D.write_dense(rows, path, "doc", model_name="m")
    assert D.validate_cache(spark, path, "doc", {"model_name": "m", "count": 4}).isEmpty()
    with pytest.raises(ValueError):
        D.write_dense(rows, path, "doc", rows.where("row_idx < 3"), model_name="m")
    assert not D.validate_cache(spark, path, "doc", {"model_name": "m"}).isEmpty()


def test_a_legacy_manifest_is_completed(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"d{i}", [1.0]) for i in range(3)], "row_idx bigint, item_id string, embedding array<float>")
    path = str(tmp_path / "cache")
    full = D.write_dense(rows, path, "doc", model_name="m").first()
    old = spark.createDataFrame([("m", "do", 3)], "model_name string, instruction string, count bigint")
    old.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/kind=doc")
    want = {"model_name": "m", "system_instruction": "do", "id_sha256": full["id_sha256"], "first_id": "d0"}
    assert D.validate_cache(spark, path, "doc", want).isEmpty()
    rows.where("row_idx < 2").write.mode("overwrite").parquet(f"{path}/vectors/kind=doc")
    assert [r["field"] for r in D.validate_cache(spark, path, "doc", want).collect()] == ["stored rows"]
