"""Dead-feature and combined objectives against NumPy, schedules, and the choice among coders."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.catalog.inputs import coder
from sparkvec.operators import coding as C
from sparkvec.operators import losses as L
from sparkvec.operators import metrics as M
from sparkvec.plans import suites


@pytest.fixture(scope="module")
def pairs(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(40, 64)).astype(np.float32)
    rows = [(i, x[i].tolist(), x[(i + 1) % 40].tolist()) for i in range(40)]
    return spark.createDataFrame(rows, "row_idx bigint, q_emb array<float>, p_emb array<float>"), x.astype(float)


@pytest.mark.parametrize("kind", [{}, {"tied": True}])
@pytest.mark.parametrize("k_aux", [3, 500])
@pytest.mark.parametrize("bound", [None, 9 * 2 * 4 * 64])
def test_auxk_against_numpy(pairs, kind, k_aux, bound):
    df, x = pairs
    c, dead = coder(**kind), np.arange(5, 250, 9)
    h = c.pre_activations(x)
    want = []
    for i in range(len(x)):
        order = sorted(range(256), key=lambda f: (-round(h[i, f], 9), f))
        main = [f for f in order if h[i, f] > 0][:c.k]
        aux = [f for f in order if f in set(dead.tolist())][:k_aux]
        table = (c.enc if c.tied else c.dec).astype(float)
        bias = 0 if c.tied else c.dec_bias.astype(float)
        seen = h[i, main] @ table[main] + bias
        other = np.log1p(np.exp(h[i, aux])) @ table[aux] + bias
        want.append(((other - (x[i] - seen)) ** 2).sum())
    got = L.auxk_loss(df, c, dead, k_aux, column="q_emb", bound=bound).first()["auxk"]
    assert math.isclose(got, np.mean(want), rel_tol=1e-5)
    assert L.auxk_loss(df, c, dead[:0], column="q_emb").first()["auxk"] == 0


def test_dead_features_include_those_never_seen(spark):
    activity = spark.createDataFrame([(0, 1), (7, 2), (3, 1)], "step int, feature_id int")
    gaps = M.steps_since_active(activity, 10, 4)
    assert L.dead_features(gaps, 5).tolist() == [0, 1, 3] and L.dead_features(gaps, 10).tolist() == []


def test_totals_of_the_regimes(pairs):
    df, _ = pairs
    dead = np.arange(0, 256, 5)
    row = lambda **o: L.combined_losses(df, o.pop("coder", coder()), dead=dead, batch_size=8, auxk_k=4, **o).first()
    p, r, s3p, s3r = row(cache="paired"), row(cache="retrieval"), row(cache="paired", stage=3), row(cache="retrieval", stage=3)
    assert p[:5] == r[:5] and s3p["auxk"] == 0
    close = lambda got, want: math.isclose(got, want, rel_tol=1e-9)
    assert close(p["total"], p["recon"] + 0.3 * p["align"] + p["auxk"] / 32)
    assert close(r["total"], r["recon"] + 0.3 * r["distill"] + r["auxk"] / 32 + 0.05 * r["contrastive"])
    assert close(s3p["total"], s3p["contrastive"] + 0.1 * s3p["recon"])
    assert close(s3r["total"], s3r["contrastive"] + 0.1 * s3r["recon"] + 0.05 * s3r["distill"])
    assert close(p["align"], L.align_loss(*(C.encode(df, coder(), None, f"{s}_emb").select("row_idx", "code") for s in "qp")).first()["align"])
    e = row(cache="paired", coder=coder(model_type="encoder_only"))
    assert (e["recon"], e["auxk"]) == (0, 0) and close(e["total"], 0.3 * e["distill"])
    assert row(cache="paired", bound=40 * 2 * 4 * 64)["total"] == pytest.approx(p["total"], rel=1e-6)
    with pytest.raises(ValueError):
        L.combined_losses(df, coder(), "other")


def test_schedules(spark):
    steps = spark.range(0, 60, 10).select(F.col("id"))
    got = steps.select(L.annealed_k(F.col("id"), 40, 256, 32).alias("a"), L.annealed_k(F.col("id"), 40, 256, 32, "cosine").alias("b"),
                       L.learning_rate_share(F.col("id"), 50, 20).alias("r")).collect()
    assert [x["a"] for x in got] == [256, 200, 144, 88, 32, 32]
    assert [x["b"] for x in got] == [256, round(32 + 224 * 0.5 * (1 + math.cos(math.pi / 4))), 144, round(32 + 224 * 0.5 * (1 + math.cos(math.pi * 0.75))), 32, 32]
    assert [round(x["r"], 6) for x in got] == [0, 0.5, 1, 0.75, 0.25, 0]
    assert (L.first_k(65536, 128), L.first_k(256, 32), L.first_k(8, 4)) == (256, 64, 4)


def test_select_coder_equals_separate_suites(spark, pairs):
    df, _ = pairs
    queries = df.select(F.col("row_idx").alias("q_idx"), F.col("q_emb").alias("embedding"))
    docs = df.select(F.col("row_idx").alias("doc_idx"), F.col("p_emb").alias("embedding"))
    rel = df.select(F.col("row_idx").alias("q_idx"), (F.pmod(F.col("row_idx") - 1, F.lit(40))).alias("doc_idx")).where("q_idx < 30")
    coders = {"a": coder(2), "b": coder(8, "encoder_only"), "c": coder(8, tied=True), "d": coder(8, tied=True)}
    got = {r["coder"]: r for r in suites.select_coder(queries, docs, rel, coders, top_k=20).collect()}
    score = suites.selection_score(queries, docs, rel, "ndcg_at_10")
    want = {name: score(c) for name, c in coders.items()}
    assert {n: round(r["value"], 9) for n, r in got.items()} == {n: round(v, 9) for n, v in want.items()}
    assert [n for n, r in got.items() if r["chosen"]] == [max(want, key=want.get)]
    none = suites.select_coder(queries, docs.where("doc_idx < 0"), rel, coders).collect()
    assert {r["value"] for r in none} == {0.0} and [r["coder"] for r in none if r["chosen"]] == ["a"]
