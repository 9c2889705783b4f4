"""Suites on planted pairs, and the whole job on files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.operators import coding as C
from sparkvec.operators import metrics as M
from sparkvec.operators.embed import HashingEmbedder
from sparkvec.plans import suites

VEC = "embedding array<float>"


@pytest.fixture(scope="module")
def planted(spark):
    """60 queries, each a noisy copy of one of 400 documents."""
    rng = np.random.default_rng(0)
    d = rng.normal(size=(400, 32))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    q = d[:60] + 0.05 * rng.normal(size=(60, 32))
    docs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(d)], f"doc_idx bigint, {VEC}")
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], f"q_idx bigint, {VEC}")
    rel = spark.createDataFrame([(i, i) for i in range(60)], "q_idx bigint, doc_idx bigint")
    enc = np.float32(rng.normal(size=(256, 32)))
    coder = C.SparseCoder(enc, np.zeros(256, np.float32), enc / np.linalg.norm(enc, axis=1, keepdims=True),
                          np.zeros(32, np.float32), 16)
    return queries, docs, rel, coder


def test_benchmark(planted):
    queries, docs, rel, coder = planted
    runs, metrics, times = suites.benchmark(
        queries, docs, rel, [16, 64], coder, ("pca", "raw_topk"), match="best")
    got = {(r["method"], r["k"]): r["ndcg_at_10"] for r in metrics.collect()}
    assert got[("dense", 0)] == pytest.approx(1.0)
    assert got[("sparse", 64)] >= got[("sparse", 16)] > 0.8
    best = 64 if got[("sparse", 64)] > got[("sparse", 16)] else 16  # ties go to the smaller k
    assert {k for m, k in got if m in ("raw_topk", "pca")} == {best}
    assert times.count() == 4 and runs.where("rank > 100").count() == 0


def test_sweep_equals_one_k_at_a_time(planted):
    queries, docs, _, coder = planted
    both = suites.sparse_sweep(queries, docs, coder, [8, 32, 9999])
    for k in (8, 32):
        one = suites.sparse_sweep(queries, docs, coder, [k])
        assert one.exceptAll(both.where(F.col("k") == k)).isEmpty()
    assert sorted(r["k"] for r in both.select("k").distinct().collect()) == [8, 32, coder.dict_size]  # clamped
    with pytest.raises(ValueError):
        suites.sparse_sweep(queries, docs, coder, [9999], within=True)


def test_sparse_vs_dense_and_retention(planted):
    metrics, stats, times = suites.sparse_vs_dense(*planted)
    kept = {r["metric"]: r["retention"] for r in M.retention(M.long_form(metrics)).collect()}
    assert 0.5 < kept["ndcg_at_10"] <= 1.0
    assert stats.first()["num_docs"] == 400 and times.first()["speedup"] > 0


def test_reconstruction_and_alignment(spark, planted):
    queries, docs, _, coder = planted
    deep = suites.reconstruction(docs, coder, 128).first()
    shallow = suites.reconstruction(docs, coder, 2).first()
    assert deep["mean_cosine"] > shallow["mean_cosine"]
    pairs = docs.select(F.col("doc_idx").alias("row_idx"), F.col("embedding").alias("image_emb"), F.col("embedding").alias("text_emb"))
    same = suites.alignment(pairs, coder).first()
    assert same["jaccard"] == pytest.approx(1, abs=1e-6) and same["retention"] == pytest.approx(1, abs=1e-6)


def test_stored_autoencoder_k(planted):
    queries, docs, _, _ = planted
    rng = np.random.default_rng(1)

    def ae(n):
        w = np.float32(rng.normal(size=(n, 32)))
        return C.DenseAE([(w, np.zeros(n, np.float32))], [(w.T.copy(), np.zeros(32, np.float32))])

    run, warnings = suites.stored_ae_run(queries, docs, ae(10), requested=[8])
    assert run.first()["k"] == 5 and len(warnings) == 1
    assert not suites.stored_ae_run(queries, docs, ae(16), requested=[8])[1]
    with pytest.raises(ValueError):
        suites.stored_ae_run(queries, docs, ae(9), k=4, strict=True)


def test_job_on_files(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(2)
    docs = [" ".join(rng.choice(words, 8)) for _ in range(30)]
    (tmp_path / "cand.jsonl").write_text("\n".join(json.dumps({"did": f"d{i}", "txt": t}) for i, t in enumerate(docs)))
    (tmp_path / "query.jsonl").write_text("\n".join(json.dumps({"qid": f"q{i}", "query_txt": docs[i]}) for i in range(6)))
    (tmp_path / "qrels.txt").write_text("\n".join(f"q{i} 0 d{i} 1" for i in range(5)))
    args = (spark, str(tmp_path / "query.jsonl"), str(tmp_path / "cand.jsonl"), str(tmp_path / "qrels.txt"),
            lambda: HashingEmbedder(32), str(tmp_path / "cache"), str(tmp_path / "out"), [8])
    long = suites.retrieval_benchmark(*args, baselines=("raw_topk",), model_name="hashing")
    got = {(r["method"], r["metric"]): r["value"] for r in long.collect()}
    assert got[("dense", "recall_at_1")] == 1.0 and ("raw_topk", "mrr") in got
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/out/runs/dense_k0").collect()]
    assert len(lines) == 5 * 30 and "q0 Q0 d0 1 1.000000 sparkvec_dense_k0" in lines
    assert json.loads(spark.read.text(f"{tmp_path}/out/report/report").first()[0])["context"]["model_name"] == "hashing"


def test_pca_sweep_against_numpy(spark):
    """Reduced and whole sizes from one fit rank as projections on the eigenvectors of the covariance do."""
    r = np.random.default_rng(2)
    x = (r.normal(size=(80, 10)) * np.linspace(3, 0.2, 10)).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_idx bigint, embedding array<float>")
    queries = docs.where("doc_idx < 7").select(F.col("doc_idx").alias("q_idx"), "embedding")
    got = {(h["k"], h["q_idx"], h["rank"]): h["doc_idx"] for h in suites.pca_sweep(queries, docs, [2, 5, 1, 30], 6).collect()}
    c = x.astype(float) - x.astype(float).mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(c.T))
    vectors = vectors[:, np.argsort(-values)]
    for k in (1, 2, 5, 30):
        z = c @ vectors[:, :min(2 * k, 10)]
        for q in range(7):
            assert [got[k, q, i + 1] for i in range(6)] == np.argsort(-(z @ z[q]), kind="stable")[:6].tolist()


def test_sweeps_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_idx bigint, embedding array<float>")
    queries = none.withColumnRenamed("doc_idx", "q_idx")
    assert suites.pca_sweep(queries, none, [1, 3]).collect() == [] and suites.raw_topk_sweep(queries, none, [1, 3]).collect() == []


def test_raw_sweep_equals_single_runs(spark):
    r = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, r.normal(size=9).tolist()) for i in range(30)], "doc_idx bigint, embedding array<float>")
    queries = docs.where("doc_idx < 4").withColumnRenamed("doc_idx", "q_idx")
    got = sorted(map(tuple, suites.raw_topk_sweep(queries, docs, [2, 5], 8).select("k", "q_idx", "rank", "doc_idx").collect()))
    want = [tuple(h) for k in (2, 5) for h in suites.raw_topk_run(queries, docs, k, 8).select("k", "q_idx", "rank", "doc_idx").collect()]
    assert got == sorted(want)
