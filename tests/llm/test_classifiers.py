import math
import random

import numpy as np
import pytest

from sparkvec.llm import quality, toxicity
from sparkvec.llm.queries import QUERIES


def held_out_accuracy(spark, frame, labels, column):
    found = frame.join(labels.select("doc_id", column), "doc_id").where("held_out").select(column, "predicted").collect()
    return sum(r[0] == r[1] for r in found) / len(found)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op9_toxicity"](spark, sf)
    assert got.count() == 10_000
    assert held_out_accuracy(spark, got, spark.read.parquet(f"{sf}/labels.parquet"), "toxic") > 0.97


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_quality"](spark, sf)
    assert got.count() == 1000
    assert held_out_accuracy(spark, got, spark.read.parquet(f"{sf}/labels.parquet"), "quality") > 0.97


ROWS = [(i, " ".join(random.Random(i).choices([f"w{n}" for n in range(400)] + ["vile" if i % 4 == 1 else "kind"] * 40, k=60))) for i in range(400)]
EDGE = [(None, "calm"), (900, None), (901, ""), (7, ROWS[7][1]), (902, "IDIOT, idiot! you moron")]


def edge_tables(spark):
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in ROWS + EDGE], "doc_id bigint, text string, label int, score double")
    labels = spark.createDataFrame([(i, int(i % 4 != 1), int(i % 4 == 1), "x") for i, _ in ROWS] + [(None, 1, 1, "x"), (5, None, None, "x")],
                                   "doc_id bigint, quality int, toxic int, text string")
    return docs, labels


@pytest.mark.parametrize("module,parts,held", [(toxicity, 3, 1), (quality, 4, 2)])
def test_edge_cases(spark, module, parts, held):
    docs, labels = edge_tables(spark)
    got = module.score(docs, labels).collect()
    assert len(got) == len(ROWS) + len(EDGE)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and toxicity.bucket(r["doc_id"], parts) == held) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    assert module.score(docs.limit(0), labels).count() == 0
    assert module.score(docs, labels.limit(0)).count() == len(got)


def test_held_out_labels_are_never_read(spark):
    docs, labels = edge_tables(spark)
    from pyspark.sql import functions as F
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_words_are_learned_from_labels(spark):
    docs, labels = edge_tables(spark)
    model, _ = toxicity.fit(docs, labels)
    assert "vile" in model["lexicon"] and "kind" not in model["lexicon"]
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept >= {0, 2, 900, 901} and 1 not in kept and 902 not in kept


def test_correlated_voters_share_their_weight(spark):
    r = random.Random(2)
    rows = {}
    for _ in range(4000):
        toxic = r.random() < 0.2
        votes = [r.random() < (0.8 if toxic else 0.02) for _ in range(3)]
        copy = votes[0]
        mask = sum(1 << k for k, v in enumerate([*votes, copy, copy]) if v)
        rows[mask] = rows.get(mask, 0) + 1
    model = toxicity.label_model(spark.createDataFrame(list(rows.items()), "mask bigint, n bigint"), 0.2, rounds=12)
    assert abs(model["prior"] - 0.2) < 0.05
    assert all(abs(model["toxic"][k] - 0.8) < 0.1 for k in range(3))
    assert model["weight"][0] < 0.6 < model["weight"][1]


def test_attention_gradient():
    r = np.random.default_rng(0)
    counts = np.array([3, 1, 4])
    x, y = r.normal(size=(8, quality.FEATURES)), np.array([1.0, 0.0, 1.0])
    model = quality.train(x, counts, y, epochs=200)
    out = quality.forward(model, x, counts)
    p = 1 / (1 + np.exp(-out["logit"]))
    assert ((p > 0.5) == (y == 1)).all() and np.allclose(np.add.reduceat(out["a"], out["starts"]), 1)


def test_passages_cover_the_text():
    words = [f"w{i}" for i in range(quality.PASSAGE_WORDS * 2 + 5)]
    assert sum(quality.passages(" ".join(words)), []) == words and quality.passages("") == [[]]
    assert math.isclose(quality.describe([])[:100].sum() ** 1, quality.describe([])[:100].sum())
