"""Queries with SQL against DuckDB, and the pipeline against brute force on a small table."""

import hashlib
from collections import Counter

import numpy as np
import oracle
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkvec.llm import toxicity
from sparkvec.llm.common import store
from sparkvec.llm.queries import ORACLES, QUERIES, vocabulary


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, name, sf):
    want = oracle.connect(sf).execute(ORACLES[name]).df()
    assert oracle.difference(QUERIES[name](spark, sf).toPandas(), want) is None


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    copies = []
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, docs, sf), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            found = out.select("doc_id", "text").collect()
            copies.append(Counter(r["doc_id"] for r in found))
            rows.append({r["doc_id"]: r["text"] for r in found})
            docs = out
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(
        spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(rows[1]) == {i for i in rows[0] if scores[i] < toxicity.THRESHOLD}
    assert len(rows[1]) < len(rows[0])
    last = {}
    for i, text in rows[1].items():
        last[text] = max(i, last.get(text, i))
    assert set(rows[2]) == set(last.values()) and max(copies[1].values()) == 1
    sets = {i: shingles(t) for i, t in rows[2].items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    near = {i: {j for x in sets[i] for j in holders[x] if j != i and like(i, j) >= 0.8} for i in sets}
    root = {}
    for i in sorted(sets):  # the smallest id of each group of links
        queue = [] if i in root else [i]
        while queue:
            j = queue.pop()
            if j not in root:
                root[j] = i
                queue += near[j]
    assert set(rows[3]) == set(root.values())
    assert set(rows[4]) == set(rows[3]) and set(copies[3].values()) <= {1, 2} and 2 in copies[3].values()
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == copies[3]
    for r in got[::7]:
        ids = tokenizer.encode(rows[4][r["doc_id"]]).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(rows[4][r["doc_id"]].encode()).hexdigest()
