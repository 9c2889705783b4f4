import math

import pytest
from pyspark.sql import functions as F

from sparkvec.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, _epoch int, epochs int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, 0) for i, t, s in rows], SCHEMA)


def rows_of(sizes, words=1):
    return [(1000 * k + i, "w " * words, f"s{k}") for k, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 7])
def test_repetition_limit_is_met_and_nothing_is_lost(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    rows = rows_of([400, 100, 40], 3)
    got = mixing.mix(table(spark, rows), max_repetition=2.0).groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"), F.max("_epoch").alias("e"), F.first("_weight").alias("w")).collect()
    by = {r["source"]: r for r in got}
    assert {s: by[s]["d"] for s in by} == {"s0": 400, "s1": 100, "s2": 40}
    a = 1 - math.log(2) / math.log(10)
    weights = [x ** a for x in (400, 100, 40)]
    for s, w, n in zip(("s0", "s1", "s2"), weights, (400, 100, 40)):
        assert abs(by[s]["w"] - w / sum(weights)) < 1e-6
        assert abs(by[s]["n"] - 400 * w / weights[0]) <= 1 and by[s]["n"] <= 2 * n


def test_entropy_target_and_budget(spark):
    docs = table(spark, rows_of([300, 60, 20]))
    target = 1.0
    got = mixing.mix(docs, max_repetition=None, entropy=target, budget=200)
    weights = {r["source"]: r["_weight"] for r in got.select("source", "_weight").distinct().collect()}
    assert abs(-sum(w * math.log(w) for w in weights.values()) - target) < 1e-5
    counts = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert all(abs(counts[s] - 200 * weights[s]) <= 1 for s in weights)


def test_epochs_are_different_permutations_and_prefixes_fill_the_budget(spark):
    docs = table(spark, [(i, "w " * (1 + i % 5), "a") for i in range(200)])
    total = sum(1 + i % 5 for i in range(200))
    got = mixing.mix(docs, max_repetition=10.0, budget=int(2.5 * total)).collect()
    epochs = {e: [r["doc_id"] for r in sorted(got, key=lambda r: r["_place"]) if r["_epoch"] == e] for e in (0, 1, 2)}
    assert sorted(epochs[0]) == sorted(epochs[1]) == list(range(200)) and epochs[0] != epochs[1]
    used = sum(1 + i % 5 for i in epochs[2])
    assert total / 2 - 5 < used <= total / 2 and len(set(epochs[2])) == len(epochs[2])


def test_nulls_repeats_one_source_and_empty(spark):
    rows = [(1, None, None), (2, "", ""), (2, "", ""), (None, "x y", "b"), (3, "z", "b")]
    docs = table(spark, rows)
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "source", "epochs", "_epoch", "_place", "_weight", "_tokens"]
    assert {(r["doc_id"], r["source"]) for r in got.collect()} == {(i, s) for i, _, s in rows} and got.count() >= len(rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(table(spark, rows_of([5]))).count() == 5


def test_a_target_is_needed(spark):
    with pytest.raises(ValueError):
        mixing.mix(table(spark, []), max_repetition=None)
