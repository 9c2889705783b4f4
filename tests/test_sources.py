"""Readers, manifests, caches and embedding on small hand-made files."""

import hashlib
import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from sparkvec.functions import items as I
from sparkvec.operators import embed as E
from sparkvec.sources import dense as D
from sparkvec.sources import records as R
from sparkvec.sources import stores
from sparkvec.sources.synthetic import mean_paired_cosine, synthetic_pairs


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # embedders below travel with the task


def _lines(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_items_keep_file_order_and_first_n(spark, tmp_path):
    for part in range(3):
        _lines(tmp_path / f"part-{part}.json", [
            json.dumps({"did": part * 100 + i, "txt": f"t{i}", "modality": None}) if i % 3 else
            "" if i % 2 else json.dumps({"did": part * 100 + i, "img_path": "x.jpg"}) for i in range(40)])
    got = [(r["row_idx"], r["item_id"]) for r in R.read_items(spark, str(tmp_path), "candidate").orderBy("row_idx").collect()]
    ids = [str(p * 100 + i) for p in range(3) for i in range(40) if i % 3 or i % 2 == 0]
    assert got == list(enumerate(ids))
    assert [r["item_id"] for r in R.read_items(spark, str(tmp_path), "candidate", 5).orderBy("row_idx").collect()] == ids[:5]


def test_small_splits_give_the_same_order(spark, tmp_path):
    _lines(tmp_path / "a.json", [json.dumps({"qid": f"q{i}", "query_txt": "x" * (i % 90)}) for i in range(500)])
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "3000")
    try:
        got = R.read_items(spark, str(tmp_path), "query")
        assert got.rdd.getNumPartitions() > 4
        assert {(r["row_idx"], r["item_id"]) for r in got.collect()} == {(i, f"q{i}") for i in range(500)}
    finally:
        spark.conf.set(key, before)


def test_malformed_line_raises(spark, tmp_path):
    path = _lines(tmp_path / "bad.json", ['{"did": 1}', "{not json"])
    with pytest.raises(Exception):
        R.read_items(spark, path, "candidate").collect()


def test_annotations_last_row_wins(spark, tmp_path):
    path = _lines(tmp_path / "a.json", [
        '{"qid": "a", "pos_cand_list": ["1"]}', '{"query_txt": "no id", "pos_cand_list": ["9"]}',
        '{"qid": "b", "neg_cand_list": ["3", "4"]}', '{"qid": "a", "pos_cand_list": ["2"]}'])
    got = {r["qid"]: (r["pos_ids"], r["neg_ids"]) for r in R.read_annotations(spark, path).collect()}
    assert got == {"a": (["2"], []), "b": ([], ["3", "4"])}


def test_qrels(spark, tmp_path):
    path = _lines(tmp_path / "q.txt", ["q1 0 d1 1", "q1 0 d1 1", "q2\t0  d2 0", "q3 0 d3", "", "q4 0 d4 x", "q5 0 d5 1.5 extra", "q6 0 d6 -1"])
    got = sorted((r["qid"], r["did"], r["rel"]) for r in R.read_qrels(spark, path).collect())
    assert got == [("q1", "d1", 1.0), ("q1", "d1", 1.0), ("q5", "d5", 1.5)]
    for bad in ("q4 0 d4 x", "q5 0 d5 1.5"):
        with pytest.raises(Exception):
            R.read_qrels(spark, _lines(tmp_path / "b.txt", [bad]), strict=True).collect()
    good = _lines(tmp_path / "g.txt", ["q1 0 d1 1", "q1 0 d1 2", "q2 0 d2 0", "q3 0 d3", "", "q3"])
    assert [(r["qid"], r["did"]) for r in R.read_qrels(spark, good, strict=True).collect()] == [("q1", "d1")]


def test_captions_from_files(spark, tmp_path):
    for name in ("train2014/COCO_train2014_1.jpg", "val2014/COCO_val2014_2.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")

    def image(name, split, n):
        return {"filename": name, "split": split, "imgid": n, "cocoid": n,
                "sentences": [{"tokens": ["a"], "raw": f" c{n}{i} ", "imgid": n, "sentid": i} for i in range(2)]}

    path = tmp_path / "captions.json"
    path.write_text(json.dumps({"images": [
        image("COCO_train2014_1.jpg", "train", 1), image("COCO_val2014_2.jpg", "restval", 2),
        image("COCO_train2014_3.jpg", "train", 3), image("COCO_val2014_4.jpg", "val", 4)]}, indent=1))
    got = sorted((r["imgid"], r["caption"]) for r in R.read_captions(spark, str(tmp_path), str(path), "train").collect())
    assert got == [(1, "c10"), (1, "c11"), (2, "c20"), (2, "c21")]
    with pytest.raises(ValueError):
        R.read_captions(spark, str(tmp_path), str(path), "dev")


def test_usable_samples_cap(spark):
    df = spark.createDataFrame([(i, "" if i % 3 == 0 else f"c{i}") for i in range(50)], "row_idx bigint, caption string").repartition(4)
    kept = [i for i in range(50) if i % 3]
    assert sorted(r["row_idx"] for r in R.usable_samples(df, 7).collect()) == kept[:7]
    assert R.usable_samples(df, 500).count() == len(kept) and R.usable_samples(df).count() == len(kept)


def _cache(tmp_path, n=20, dim=4, spare=3):
    x = np.float32(np.random.default_rng(0).normal(size=(n, dim)))
    np.vstack([x, np.zeros((spare, dim), np.float32)]).tofile(tmp_path / "doc_embeddings.npy")
    ids = [f"d{i}" for i in range(n)]
    (tmp_path / "doc_ids.json").write_text(json.dumps(ids))
    (tmp_path / "doc_meta.json").write_text(json.dumps({"count": n, "embedding_dim": dim, "instruction": "hi"}))
    return x, ids


def test_raw_cache(spark, tmp_path):
    x, ids = _cache(tmp_path)
    df = D.read_raw_dense(spark, str(tmp_path), "doc", split_bytes=60)
    rows = df.orderBy("row_idx").collect()
    assert [r["item_id"] for r in rows] == ids
    assert np.array_equal(np.float32([r["embedding"] for r in rows]), x)
    meta = json.loads((tmp_path / "doc_meta.json").read_text())
    full = D.complete_legacy(meta, df)
    assert full["system_instruction"] == "hi" and full["text_prefix"] == "" and full["cache_version"] == 2
    assert full["id_sha256"] == hashlib.sha256("\n".join(ids).encode()).hexdigest()
    assert (full["first_id"], full["last_id"]) == ("d0", "d19")


def test_truncated_cache_raises(spark, tmp_path):
    _cache(tmp_path, n=20, spare=0)
    (tmp_path / "doc_meta.json").write_text(json.dumps({"count": 25, "embedding_dim": 4}))
    with pytest.raises(Exception, match="shorter"):
        D._read_matrices(spark, str(tmp_path), {"e": "doc_embeddings.npy"}, 25, 4, 1000).collect()


def test_write_dense_refuses_wrong_ids(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [2.0])], "row_idx bigint, item_id string, embedding array<float>")
    wrong = spark.createDataFrame([(0, "b"), (1, "a")], "row_idx bigint, item_id string")
    with pytest.raises(ValueError, match="differ"):
        D.write_dense(rows, str(tmp_path), "doc", wrong)
    reasons = D.validate_cache(spark, str(tmp_path), "doc", {}).collect()
    assert [(r["field"], r["expected"]) for r in reasons] == [("missing files", "manifest")]


class _Counting(E.HashingEmbedder):
    """Leaves a file for every embedded batch."""

    def __init__(self, folder):
        super().__init__(16)
        self.folder = folder

    def embed(self, batch):
        import os
        import uuid
        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        return super().embed(batch)


def test_cached_embedding(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    folder = str(log)
    items = spark.createDataFrame([(i, f"d{i}", f"text {i}") for i in range(9)], "row_idx bigint, item_id string, text string")
    cls = _Counting

    def run(expected, **kw):
        before = len(list(log.iterdir()))
        D.embed_cached(items, lambda: cls(folder), str(tmp_path / "c"), "doc", expected, **kw).count()
        return len(list(log.iterdir())) - before

    base = {"model_name": "a", "text_prefix": "", "batch_size": 256}
    assert run(base) > 0 and run(base) == 0
    assert run(base, overwrite=True) > 0
    assert run({**base, "model_name": "b"}, skip_validation=True) == 0
    assert run({**base, "model_name": "b"}) > 0
    with pytest.raises(ValueError):
        run(base, overwrite=True, skip_validation=True)


class _Broken(E.HashingEmbedder):
    def embed(self, batch):
        if any("bad" in r["text"] for r in batch):
            raise RuntimeError("cannot embed")
        return super().embed(batch)


class _Short(E.HashingEmbedder):
    def embed(self, batch):
        return super().embed(batch)[:-1]


def test_embedder_errors(spark):
    items = spark.createDataFrame([(0, "fine"), (1, "bad")], "row_idx bigint, text string")
    broken, short = _Broken, _Short
    for mode in ("raise", "retry_items"):
        with pytest.raises(Exception, match="cannot embed"):
            E.embed(items, lambda: broken(8), on_error=mode).collect()
    with pytest.raises(Exception, match="returned"):
        E.embed(items, lambda: short(8)).collect()
    out = E.embed(items, lambda: E.make_embedder("hashing", dim=8), batch_size=1).collect()
    assert np.allclose([np.linalg.norm(r["embedding"]) for r in out], 1, atol=1e-6)
    with pytest.raises(ValueError):
        E.make_embedder("nothing")


def test_registered_embedder(spark):
    E.register_embedder("fixed", lambda: E.HashingEmbedder(4))
    assert E.make_embedder("fixed").dim == 4


def test_image_required(spark):
    rows = [("a", "query", ["image"], "", None), ("b", "query", ["image", "text"], "t", None)]
    df = spark.createDataFrame(rows, "item_id string, kind string, modality array<string>, text string, image binary")
    assert E.require_image(df.where("item_id = 'b'")).first()["degraded"]
    with pytest.raises(Exception, match="image missing for item a"):
        E.require_image(df).collect()


def test_synthetic_pairs_do_not_depend_on_partitions(spark):
    a = synthetic_pairs(spark, 50, 8).orderBy("row_idx").collect()
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        b = synthetic_pairs(spark, 50, 8).orderBy("row_idx").collect()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        else:
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
    assert a == b
    high = mean_paired_cosine(synthetic_pairs(spark, 50, 64, r=0.9)).first()[0]
    assert high > mean_paired_cosine(synthetic_pairs(spark, 50, 64, r=0.3)).first()[0]


def test_report(spark, tmp_path):
    metrics = spark.createDataFrame([("s", 8, "mrr", 0.5), ("s", 16, "mrr", 0.6), ("dense", 0, "mrr", 0.7)],
                                    "method string, k int, metric string, value double")
    times = spark.createDataFrame([("s", 8, "search", 1.5)], "method string, k int, stage string, seconds double")
    stores.write_report(metrics, times, str(tmp_path), prefix="p")
    body = json.loads(spark.read.text(f"{tmp_path}/report").first()[0])
    by_method = {m["method"]: m for m in body["methods"]}
    assert by_method["s"]["primary_k"] == 8 and len(by_method["s"]["suite"]) == 2
    assert body["timings"][0]["seconds"] == 1.5 and body["context"]["prefix"] == "p"


def test_text_functions(spark):
    df = spark.createDataFrame([(None, "x", "p.jpg"), (" TEXT ,, image", "", ""), ("", "", None)], "m string, t string, i string")
    got = [r[0] for r in df.select(I.item_modality("m", "t", "i")).collect()]
    assert got == [["image", "text"], ["image", "text"], []]
    one = spark.createDataFrame([("CIRR_task7",), ("other",)], "d string").select(I.default_prefix("d")).collect()
    assert one[0][0].startswith("Retrieve a day-to-day") and one[1][0] == I.GENERIC_PREFIX
