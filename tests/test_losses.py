"""Objectives against direct NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.functions import vector as V
from sparkvec.operators import losses as L

CODE = V.CODE_TYPE


def _dense(code, size=10):
    z = np.zeros(size)
    for f, w in code:
        z[f] = w
    return z


def _random_codes(rng, n):
    return [[(int(f), float(np.float32(rng.random()))) for f in rng.choice(10, 4, replace=False)] for _ in range(n)]


@pytest.mark.parametrize("with_negatives", [False, True])
def test_contrastive_on_codes(spark, with_negatives):
    rng = np.random.default_rng(0)
    q, p = _random_codes(rng, 9), _random_codes(rng, 9)
    neg = [_random_codes(rng, int(rng.integers(0, 4))) for _ in range(9)]
    batch = [i % 2 for i in range(9)]
    want = []
    for i in range(9):
        mates = [j for j in range(9) if batch[j] == batch[i]]
        logits = [_dense(q[i]) @ _dense(p[j]) / 0.1 for j in mates]
        own = logits[mates.index(i)]
        if with_negatives:
            logits += [_dense(q[i]) @ _dense(c) / 0.1 for c in neg[i]]
        want.append(np.log(np.exp(logits).sum()) - own)
    schema = f"batch int, q_idx bigint, q {CODE}, p {CODE}, neg array<{CODE}>"
    rows = spark.createDataFrame(list(zip(batch, range(9), q, p, neg)), schema).repartition(3)
    got = L.contrastive_terms(rows if with_negatives else rows.drop("neg"), 0.1).orderBy("q_idx").collect()
    assert np.allclose([r["loss"] for r in got], want)


def test_alignment(spark):
    rng = np.random.default_rng(1)
    a, b = _random_codes(rng, 12), _random_codes(rng, 12)
    want = []
    for x, y in zip(a, b):
        x, y = _dense(x), _dense(y)
        both = (x > 0) & (y > 0)
        want.append(((x > 0) != (y > 0)).sum() + 0.5 * (np.abs(x - y) * both).sum())
    frames = [spark.createDataFrame(list(enumerate(c)), f"row_idx bigint, code {CODE}") for c in (a, b)]
    assert L.align_loss(*frames).first()[0] == pytest.approx(np.mean(want))


def test_normalised_error(spark):
    rng = np.random.default_rng(2)
    x, y = np.float32(rng.normal(size=(20, 5))), np.float32(rng.normal(size=(20, 5)))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "embedding array<float>, x_hat array<float>")
    want = ((x - y) ** 2).mean() / ((x - x.mean(axis=0)) ** 2).mean()
    assert L.norm_mse(df.repartition(4)).first()[0] == pytest.approx(want, rel=1e-5)


def test_batches_are_even(spark):
    rows = spark.range(5000).withColumnRenamed("id", "q_idx")
    sizes = [r["count"] for r in L.assign_batches(rows, "q_idx", 5000, 100).groupBy("batch").count().collect()]
    assert len(sizes) == 50 and max(sizes) < 160
    assert L.assign_batches(rows, "q_idx", 5000, 10_000).select(F.max("batch")).first()[0] == 0
