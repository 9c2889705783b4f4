import itertools
import random

import numpy as np
import pytest

from sparkvec.llm import language as G


def brute_marginals(scores, transitions):
    """Label probabilities, log normaliser and label pairs of one sequence by going through all labelings."""
    n, k = scores.shape
    p, pairs, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        v = np.exp(sum(scores[i, a] for i, a in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        total += v
        for i, a in enumerate(path):
            p[i, a] += v
        for a, b in zip(path, path[1:]):
            pairs[a, b] += v
    return p / total, np.log(total), pairs / total


@pytest.mark.parametrize("segment", [1, 2, 3, 32])
def test_forward_backward_against_all_labelings(monkeypatch, segment):
    monkeypatch.setattr(G, "SEGMENT", segment)
    r = np.random.default_rng(segment)
    counts = np.array([5, 0, 1, 7, 2, 0, 3])
    t = r.normal(0, 1, (3, 3))
    scores = r.normal(0, 2, (int(counts.sum()), 3))
    p, log_z, pairs = G.marginals(scores, counts, t, pairs=True)
    ends = np.cumsum(counts)
    want = [brute_marginals(scores[e - n:e], t) for e, n in zip(ends, counts) if n]
    assert np.allclose(p, np.vstack([w[0] for w in want]))
    assert np.isclose(log_z, sum(w[1] for w in want)) and np.allclose(pairs, sum(w[2] for w in want))
    assert G.marginals(scores[:0], np.zeros(2, int), t)[0].shape == (0, 3)


def test_long_sequences_equal_one_segment(monkeypatch):
    r = np.random.default_rng(0)
    t, scores = r.normal(0, 3, (4, 4)), r.normal(0, 20, (900, 4))
    p = G.marginals(scores, np.array([700, 200]), t)[0]
    monkeypatch.setattr(G, "SEGMENT", 700)
    assert np.allclose(p, G.marginals(scores, np.array([700, 200]), t)[0])


def test_features_of_a_word():
    word, bucket, value, _ = G.describe(["Ab", "abcd"], np.empty(0, np.uint64))
    assert np.bincount(word).tolist() == [2 + 2 + 1, 3 + 4 + 3 + 2]
    pair = lambda w: sorted(zip(*(x[word == w].tolist() for x in (bucket, value))))
    again = G.describe(["zz", "ABCD"], np.empty(0, np.uint64))
    assert sorted(zip(again[1][again[0] == 1].tolist(), again[2][again[0] == 1].tolist())) == pair(1)
    *_, whole = G.describe(["ab", "ba"], np.empty(0, np.uint64))
    got = G.describe(["ab", "ba"], whole[:1])
    assert np.bincount(got[0]).tolist() == [6, 5]


WORDS = {"xx": "ba ke lo mi nu".split(), "yy": "strin gruft plonk schra wolt".split(), "zz": "éàu çiê ôin âme ûlê".split()}


def make(r, lang, n):
    return " ".join("".join(r.choice(WORDS[lang]) for _ in range(r.choice([1, 2]))) for _ in range(n))


def corpus(spark):
    r = random.Random(3)
    truth = {i: r.choice(list(WORDS)) for i in range(240)}
    rows = [(i, make(r, lang, r.choice([3, 40, 200])), lang if i % 5 else None, "h") for i, lang in truth.items()]
    rows += [(900, None, "xx", "h"), (901, "", "yy", "h"), (902, "12 345 _ ² Ⅷ !", "zz", "h"), (None, make(r, "yy", 9), "xx", "h"),
             (903, make(r, "xx", 30_000), "xx", "h"), (0, rows[0][1], rows[0][2], "h")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, h string").repartition(4), truth


def test_predictions_and_odd_rows(spark):
    docs, truth = corpus(spark)
    got = G.predict(docs).collect()
    assert len(got) == docs.count()
    found = {r["doc_id"]: r for r in got}
    assert all(found[i]["lang_pred"] == k for i, k in truth.items())
    assert all((found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert found[None]["lang_pred"] == "yy" and not found[None]["held_out"] and found[903]["lang_pred"] == "xx" and found[903]["n_words"] == 30_000
    assert all(0 <= r["score"] <= 1 for r in got)
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)


def test_held_out_labels_are_not_learned(spark):
    from pyspark.sql import functions as F
    docs, _ = corpus(spark)
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "qq").otherwise(F.col("lang")))
    assert sorted(map(str, G.predict(docs).collect())) == sorted(map(str, G.predict(other).collect()))


def test_switched_text(spark):
    docs, _ = corpus(spark)
    model = G.fit(docs)
    r = random.Random(1)
    a, b = make(r, "xx", 30), make(r, "yy", 30)
    text = a + ". 77 " + b
    row = spark.createDataFrame([(1, text), (2, None), (3, "5")], "doc_id bigint, text string")
    got = {x["doc_id"]: x["runs"] for x in G.language_runs(row, model).collect()}
    assert [(x["start"], x["end"], x["lang"]) for x in got[1]] == [(0, len(a), "xx"), (len(a) + 5, len(text), "yy")]
    assert got[2] == got[3] == []
    assert model["transitions"].argmax(axis=1).tolist() == [0, 1, 2]


def test_nothing_to_learn(spark):
    docs, _ = corpus(spark)
    from pyspark.sql import functions as F
    assert {r["lang_pred"] for r in G.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert G.predict(docs.limit(0)).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = G.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got) > 100
