"""Jobs stopped and started again give the batch result, each item once."""

import json

import pytest
from pyspark.sql import functions as F

from sparkvec.operators.embed import HashingEmbedder, embed
from sparkvec.operators.search import build_index
from sparkvec.sources import records
from sparkvec.sources.stores import read_index
from sparkvec.streaming import jobs


def _write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def _job(spark, source, path, guard=None):
    stream = records.read_items_stream(spark, str(source), "candidate", max_files=1)
    jobs.embed_stream(stream, lambda: HashingEmbedder(16), path, guard or {"model_name": "h"}).awaitTermination()
    return jobs.read_embedded(spark, path)


def test_resume(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rows = [{"did": f"d{i}", "txt": f"word{i} word{i % 3}"} for i in range(12)]
    for part in range(2):
        _write(source, f"{part}.json", rows[part * 4:part * 4 + 4])
    assert _job(spark, source, path).count() == 8
    _write(source, "2.json", rows[8:])
    _job(spark, source, path)
    got = _job(spark, source, path)  # nothing new
    assert sorted(r["item_id"] for r in got.collect()) == sorted(r["did"] for r in rows)
    batch = embed(records.read_items(spark, str(source), "candidate"), lambda: HashingEmbedder(16))
    want = {r["item_id"]: r["embedding"] for r in batch.collect()}
    assert {r["item_id"]: r["embedding"] for r in got.collect()} == want


def test_guard(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    _write(source, "0.json", [{"did": "a", "txt": "x"}])
    _job(spark, source, path, {"model_name": "h", "dim": 16})
    with pytest.raises(ValueError, match="model_name expected other, found h"):
        _job(spark, source, path, {"model_name": "other", "dim": 16})


def test_batch_written_twice_counts_once(spark, tmp_path):
    """The sink of a micro-batch replaces its own folder when the batch is run again."""
    codes = spark.createDataFrame([(0, [(1, 1.0)]), (1, [(1, 0.5)])], jobs.CODES_SCHEMA)
    from sparkvec.sources.stores import write_index
    for _ in range(2):
        write_index(build_index(codes), str(tmp_path), batch="0")
    write_index(build_index(codes.withColumn("doc_idx", F.col("doc_idx") + 2)), str(tmp_path), batch="1")
    index = read_index(spark, str(tmp_path))
    assert index.postings.count() == 4 and sorted(r["doc_idx"] for r in index.docs.collect()) == [0, 1, 2, 3]


def test_activity_over_restarts(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "feature_id bigint, step bigint"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.activity_snapshot(jobs.stream_table(spark, source, schema), path).awaitTermination()
        return {r["feature_id"]: r["gap"] for r in jobs.read_activity(spark, path, 10).collect()}

    assert add([(1, 2), (1, 5), (2, 0)]) == {1: 4, 2: 9}
    assert add([(2, 9), (3, 1), (1, 4)]) == {1: 4, 2: 0, 3: 8}
    assert add([(3, 6)]) == {1: 4, 2: 0, 3: 3}
    last = spark.read.parquet(f"{path}/activity/batch=2").collect()  # the third batch touched one feature only
    assert [(r["feature_id"], r["last_step"]) for r in last] == [(3, 6)]
