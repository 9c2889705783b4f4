import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.catalog.inputs import coder
from sparkvec.functions import vector as V
from sparkvec.operators import coding as C
from sparkvec.sources import stores


@pytest.fixture(scope="module")
def dense(spark):
    x = np.float32(np.random.default_rng(0).normal(size=(60, 64)))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_idx bigint, embedding array<float>"), x


def _lists(df):
    return {r["row_idx"]: [(e["feature_id"], e["weight"]) for e in r["code"]] for r in df.collect()}


def test_encode_matches_numpy(dense):
    df, x = dense
    c = coder()
    h = (x.astype(float) - c.dec_bias) @ c.enc.T.astype(float) + c.enc_bias
    got = _lists(C.encode(df, c, 10))
    for i in range(len(x)):
        order = [f for f in np.argsort(-h[i], kind="stable")[:10] if h[i, f] > 0]
        assert [f for f, _ in got[i]] == order
        assert np.allclose([w for _, w in got[i]], h[i, order], rtol=1e-6)


def test_codes_are_nested(dense):
    df, _ = dense
    wide = _lists(C.encode(df, coder(), 64))
    for k in (1, 7, 32):
        assert _lists(C.encode(df, coder(), k)) == {i: c[:k] for i, c in wide.items()}


def test_k_is_clamped(dense):
    df, _ = dense
    assert max(len(c) for c in _lists(C.encode(df, coder(), 10_000)).values()) <= 256
    assert max(len(c) for c in _lists(C.encode(df, coder(), 0)).values()) == 1
    assert max(len(c) for c in _lists(C.encode(df, coder(k=5))).values()) == 5


def test_decode_and_forward(dense):
    df, x = dense
    c = coder()
    row = C.forward(df, c, 12).where("row_idx = 3").first()
    z = {e["feature_id"]: e["weight"] for e in row["code"]}
    want = sum(w * c.dec[f].astype(float) for f, w in z.items()) + c.dec_bias
    assert np.allclose(row["x_hat"], want, atol=1e-5)
    assert row["active_dims"] == len(z) and row["positive_pre"] >= len(z)


def test_sharded_encode_equals_broadcast(spark, dense):
    df, _ = dense
    weights, meta = coder().to_frames(spark)
    got = _lists(C.encode_sharded(df, weights, meta, 9, shard_features=70))
    assert got == _lists(C.encode(df, coder(), 9))


@pytest.mark.parametrize("kind", [{}, {"model_type": "encoder_only"}, {"tied": True}])
def test_pieces_equal_the_whole_coder(spark, dense, tmp_path, monkeypatch, kind):
    df, _ = dense
    whole = coder(**kind)
    stores.write_weights(whole, spark, str(tmp_path), source="test")
    stored = stores.stored_coder(spark, str(tmp_path))
    monkeypatch.setattr(C, "GROUP_BYTES", 3000)
    rows = lambda out: {r["row_idx"]: (r["code"], np.array(r["x_hat"]), r["active_dims"], r["positive_pre"]) for r in out.collect()}
    codes = C.encode(df, whole, 9)
    want = rows(C.forward(df, whole, 9))
    for other in (C.forward(df, whole, 9, bound=1 << 15), C.forward(df, stored, 9, bound=1 << 15)):
        got = rows(other)
        assert set(got) == set(want)
        for key, (code, x_hat, *counts) in want.items():
            assert got[key][0] == code and list(got[key][2:]) == counts and np.allclose(got[key][1], x_hat, atol=1e-5)
    for one in (whole, stored):
        assert _lists(C.encode(df, one, 9, bound=1 << 15)) == _lists(codes)
        got = {r["row_idx"]: r["x_hat"] for r in C.decode(codes, one, bound=1 << 15).collect()}
        assert all(np.allclose(got[r["row_idx"]], r["x_hat"], atol=1e-5) for r in C.decode(codes, whole).collect())
    plan = C.forward(df, whole, 9, bound=1 << 15)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert C.forward(df.where("row_idx < 0"), whole, 9, bound=1 << 15).count() == 0


def test_missing_weight_rows_are_noticed(spark, dense):
    weights, meta = coder().to_frames(spark)
    with pytest.raises(ValueError, match="not complete"):
        C.encode_sharded(dense[0], weights.where("feature_id <> 80"), meta, 9, shard_features=70)


def test_weights_round_trip(spark, dense, tmp_path):
    for kind in ({}, {"model_type": "encoder_only"}, {"tied": True}):
        c = coder(**kind)
        stores.write_weights(c, spark, str(tmp_path), source="test")
        back = stores.read_weights(spark, str(tmp_path))
        assert np.array_equal(back.enc, c.enc) and back.k == c.k and back.model_type == c.model_type
        assert back.tied == c.tied and _lists(C.encode(dense[0], back)) == _lists(C.encode(dense[0], c))


def test_dense_ae_round_trip_and_gelu(spark, tmp_path):
    rng = np.random.default_rng(1)
    m = C.DenseAE([(np.float32(rng.normal(size=(8, 6))), np.float32(rng.normal(size=8))),
                   (np.float32(rng.normal(size=(3, 8))), np.float32(rng.normal(size=3)))],
                  [(np.float32(rng.normal(size=(8, 3))), np.float32(rng.normal(size=8))),
                   (np.float32(rng.normal(size=(6, 8))), np.float32(rng.normal(size=6)))])
    stores.write_dense_ae(m, spark, str(tmp_path))
    back = stores.read_dense_ae(spark, str(tmp_path))
    x = rng.normal(size=(5, 6))
    assert back.architecture == "mlp" and np.allclose(back.encode(x), m.encode(x))
    assert np.allclose(back.decode(m.encode(x)), m.decode(m.encode(x)))
    assert C.gelu(np.array([0.0, 1.0]))[1] == pytest.approx(0.8413447, abs=1e-6)
    assert C.hidden_dim(2048, 64) == 512 and C.hidden_dim(256, 64) == 256


def test_pca(spark, dense):
    df, x = dense
    m = C.pca_fit(df, 5, max_docs=None)
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    overlap = np.linalg.norm(vt[:5] @ m.components)
    assert overlap == pytest.approx(np.sqrt(5), abs=1e-5)  # same subspace, whatever the signs
    assert C.pca_fit(df, 64).method == "identity"
    sampled = C.pca_fit(df, 5, max_docs=30)
    assert sampled.n_fit == 30
    got = np.array([r["latent"] for r in C.pca_project(df, m).orderBy("row_idx").collect()])
    assert np.allclose(got, (x - m.mean) @ m.components, atol=1e-4)


def test_wrong_inputs(spark, dense):
    df, _ = dense
    short = df.select("row_idx", F.slice("embedding", 1, 10).alias("embedding"))
    with pytest.raises(Exception, match="dims"):
        C.encode(short, coder()).collect()
    with pytest.raises(ValueError):
        V.raw_topk("embedding", 0)
    with pytest.raises(ValueError):
        C.SparseCoder(np.zeros((2, 2)), np.zeros(2), None, None, 1, "other")
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "row_idx bigint, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        C.encode(ragged, coder()).collect()


def test_raw_topk_ties_and_zeros(spark):
    df = spark.createDataFrame([([0.0, -2.0, 2.0, 1.0, 0.0],)], "v array<float>")
    code = df.select(V.raw_topk("v", 4).alias("c")).first()["c"]
    assert [(e["feature_id"], e["weight"]) for e in code] == [(1, -2.0), (2, 2.0), (3, 1.0)]
