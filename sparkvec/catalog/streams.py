"""Embedding and streaming jobs."""

from pyspark.sql import functions as F

from ..functions import items as I
from ..functions import vector as V
from ..operators import embed as E
from ..operators.search import build_index
from ..sources import index_store, records
from ..sources.stores import read_index
from ..streaming import jobs
from . import inputs as X
from .records import _candidate_file
from .registry import query
from .retrieval import _TEXT_SQL, text_vectors


def _hashing():
    return E.HashingEmbedder(64)


def _rows(df, key):
    """Non-zero components, as the hashing query lists them."""
    return df.select(key, F.posexplode("embedding").alias("f", "w")).where(F.col("w") != 0).select(
        key, "f", X.r6(F.col("w").cast("double")).alias("w"))


_DOC_ROWS = f"WITH {_TEXT_SQL} SELECT id AS doc_id, f, round(w::DOUBLE, 6) AS w FROM emb WHERE side = 'd' AND w <> 0"


@query("E1_E7_embed", _DOC_ROWS)
def e1(spark, sf):
    return _rows(text_vectors(spark, sf, "documents", "doc_id", "doc_id"), "doc_id")


class _Fragile(E.HashingEmbedder):
    """Refuses batches of more than one item, as an engine that runs out of memory would."""

    def embed(self, batch):
        if len(batch) > 1:
            raise RuntimeError("batch failed")
        return super().embed(batch)


@query("E2_retry_items", _DOC_ROWS)
def e2(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "text")
    return _rows(E.embed(docs, lambda: _Fragile(64), 32, "retry_items", keep=["doc_id"]), "doc_id")


@query("E7_embed_relational", _DOC_ROWS)
def e7(spark, sf):
    """The hashing embedder as an aggregate over exploded tokens."""
    counts = E.hashing_vectors(X.table(spark, sf, "documents"), "doc_id", 64)
    norms = counts.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    return counts.join(norms, "doc_id").select(
        "doc_id", "f", (F.col("c") / (F.col("n") + V.EPS)).cast("float").alias("w")).where(F.col("w") != 0).select(
        "doc_id", "f", X.r6(F.col("w").cast("double")).alias("w"))


class _ByteImages(E.HashingEmbedder):
    """Image bytes are read as text."""

    def embed(self, batch):
        return super().embed([{"text": r["text"] if r["image"] is None else r["image"].decode()} for r in batch])


_PAIRS_SQL = f"""WITH {_TEXT_SQL.replace("SELECT 'q' AS side, item_id AS id, text FROM benchmark",
  "SELECT 'h' AS side, page_id AS id, html AS text FROM pages UNION ALL SELECT 'u', page_id, url FROM pages")},
s AS (SELECT t.id, sum(t.w::DOUBLE * i.w::DOUBLE) AS s FROM emb t JOIN emb i ON i.f = t.f AND i.id = t.id
  AND t.side = 'u' AND i.side = 'h' GROUP BY t.id),
n AS (SELECT id, sum(w::DOUBLE * w::DOUBLE) AS n FROM emb WHERE side = 'u' GROUP BY id)
SELECT page_id, page_id % 3 = 0 AS image_fallback,
  round(CASE WHEN page_id % 3 = 0 THEN n ELSE coalesce(s, 0) END, 5) AS dot
FROM pages JOIN n ON n.id = page_id LEFT JOIN s ON s.id = page_id"""


@query("E3_embed_pairs", _PAIRS_SQL)
def e3(spark, sf):
    """Page address as text, markup as image; a third of the images failed to load."""
    items = X.table(spark, sf, "pages").select("page_id", F.col("url").alias("text"), F.when(
        F.col("page_id") % 3 != 0, F.col("html").cast("binary")).alias("image"))
    out = E.embed_pairs(items, lambda: _ByteImages(64))
    return out.select("page_id", "image_fallback", F.round(V.dot("image_emb", "text_emb"), 5).alias("dot"))


class _FailingImages(_ByteImages):
    def embed(self, requests):
        if any(r["image"] == b"broken" for r in requests):
            raise ValueError("no image")
        return super().embed(requests)


@query("E3_failing_images", _PAIRS_SQL)
def e3_failing(spark, sf):
    """The same, but the images are there and a third of them can't be encoded."""
    items = X.table(spark, sf, "pages").select("page_id", F.col("url").alias("text"), F.when(
        F.col("page_id") % 3 != 0, F.col("html").cast("binary")).otherwise(F.lit(b"broken")).alias("image"))
    out = E.embed_pairs(items, lambda: _FailingImages(64))
    return out.select("page_id", "image_fallback", F.round(V.dot("image_emb", "text_emb"), 5).alias("dot"))


@query("E4_require_image", f"WITH {X.CANDIDATES} SELECT did AS item_id, list_contains(modes, 'image') AS degraded, length(coalesce(nullif(txt, ''), 'x'))::INTEGER AS n FROM modal")
def e4(spark, sf):
    """No image loads: items keep their text and are marked."""
    items = X.candidates(spark, sf).select(
        F.col("did").alias("item_id"), F.coalesce(F.nullif("txt", F.lit("")), F.lit("x")).alias("text"),
        I.item_modality("modality", "txt", "img_path").alias("modality"), F.lit(None).cast("binary").alias("image"))
    return E.require_image(items).select("item_id", "degraded", F.length("text").alias("n"))


@query("E5_embed_route", f"""WITH {X.CANDIDATES} SELECT did AS item_id,
CASE WHEN list_contains(modes, 'image') AND coalesce(txt, '') = '' THEN 'target' ELSE 'query' END AS route FROM modal""")
def e5(spark, sf):
    items = X.candidates(spark, sf).withColumn("row_idx", F.lit(0).cast("bigint"))
    return E.embed_route(records.to_items(items, "candidate")).select("item_id", "route")


@query("E6_text_only_pairs", f"""WITH {_TEXT_SQL} SELECT id AS doc_id, round(sum(w::DOUBLE * w::DOUBLE), 5) AS dot, true AS image_fallback
FROM emb WHERE side = 'd' GROUP BY id""")
def e6(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "text")
    return E.embed_pairs(docs, _hashing, mode="text_only").select(
        "doc_id", F.round(V.dot("image_emb", "text_emb"), 5).alias("dot"), "image_fallback")


_ITEM_TEXT_SQL = _TEXT_SQL.replace("SELECT 'q' AS side, item_id AS id, text FROM benchmark",
  "SELECT 'p' AS side, page_id AS id, CASE WHEN page_id % 2 = 0 THEN '' ELSE '  ' || url || ' ' END AS text FROM pages")


@query("X1_S10_resumed_embedding", f"WITH {_ITEM_TEXT_SQL} SELECT side || id AS item_id, f, round(w::DOUBLE, 6) AS w FROM emb WHERE w <> 0")
def x1(spark, sf):
    """The job is started twice: the second start finds nothing left to embed."""
    source, path = _candidate_file(spark, sf), X.scratch(spark, "job")
    for _ in range(2):
        stream = records.read_items_stream(spark, source, "candidate", max_files=2)
        jobs.embed_stream(stream, _hashing, path, {"model_name": "hashing", "dim": 64}).awaitTermination()
    return _rows(jobs.read_embedded(spark, path), "item_id")


@query("X2_incremental_index", f"WITH {X.search_sql(X.raw_sql())} {X.RUN_ROWS}")
def x2(spark, sf):
    """Documents arrive as several files; searching the grown index equals searching a whole one."""
    source, path = X.scratch(spark, "arrivals") + "/codes", X.scratch(spark, "grown")
    X.raw_codes(spark, sf, "doc_idx").repartition(3).write.parquet(source)
    jobs.index_stream(jobs.stream_table(spark, source, jobs.CODES_SCHEMA), path).awaitTermination()
    return X.run_rows(read_index(spark, path).search(X.raw_codes(spark, sf, "q_idx"), X.TOP))


def _changed(spark, sf):
    """An index of all documents, then a batch of shorter codes for every third, then one that deletes every
    seventh and brings every fourteenth back as it was; merged into a base on the way."""
    source, path = X.scratch(spark, "changes") + "/codes", X.scratch(spark, "versions")
    short, whole = X.raw_codes(spark, sf, "doc_idx", 8), X.raw_codes(spark, sf, "doc_idx")
    gone = whole.where("doc_idx % 7 = 0").withColumn("code", F.when(F.col("doc_idx") % 14 == 0, F.col("code")))
    index_store.write_index(build_index(whole), path)
    for rows, merged in ((short.where("doc_idx % 3 = 0"), 1), (gone, 0), (short.where("doc_idx % 15 = 0"), 0)):
        rows.coalesce(1).write.mode("append").parquet(source)
        jobs.index_stream(jobs.stream_table(spark, source, jobs.CODES_SCHEMA), path, compact_every=merged).awaitTermination()
    return path


_CHANGED = X.raw_sql().replace("codes AS", "origin AS", 1) + """,
docs AS (SELECT vec_id, f, w, r FROM origin WHERE (vec_id % 7 <> 0 OR vec_id % 14 = 0 OR vec_id % 15 = 0)
         AND r <= CASE WHEN vec_id % 15 = 0 OR (vec_id % 3 = 0 AND vec_id % 7 <> 0) THEN 8 ELSE 16 END)"""

_CHANGED_RUN = f"""WITH {_CHANGED}, shared AS (SELECT q.vec_id AS q_idx, d.vec_id AS doc_idx, sum(q.w::DOUBLE * d.w::DOUBLE) AS s
    FROM origin q JOIN docs d ON d.f = q.f GROUP BY ALL),
run AS (SELECT * FROM (SELECT q_idx, doc_idx, row_number() OVER (PARTITION BY q_idx ORDER BY round(s, 9) DESC, doc_idx) AS rank,
    s AS score FROM shared) WHERE rank <= {X.TOP}) {X.RUN_ROWS}"""


@query("X2_updated_index_scan", _CHANGED_RUN)
def x2_scan(spark, sf):
    return X.run_rows(read_index(spark, _changed(spark, sf)).search(X.raw_codes(spark, sf, "q_idx"), X.TOP))


@query("X2_updated_index_postings", _CHANGED_RUN)
def x2_postings(spark, sf):
    return X.run_rows(read_index(spark, _changed(spark, sf)).lookup(X.raw_codes(spark, sf, "q_idx"), X.TOP))


@query("X2_R8_updated_statistics", f"""WITH {_CHANGED} SELECT (SELECT count(DISTINCT vec_id) FROM docs) AS num_docs, count(DISTINCT f) AS features_used,
format('{{:.1f}}', round_even(count(*) / count(DISTINCT f), 1)) AS avg_posting_length,
format('{{:.1f}}', round_even(count(*) / count(DISTINCT vec_id), 1)) AS avg_doc_length FROM docs""")
def x2_stats(spark, sf):
    return index_store.stored_index_stats(spark, _changed(spark, sf))


@query("X3_activity_stream", """SELECT user_id AS feature_id, max(date_diff('hour', TIMESTAMP '2024-01-01', ts))::BIGINT AS last_step,
(719 - max(date_diff('hour', TIMESTAMP '2024-01-01', ts)))::BIGINT AS gap FROM events GROUP BY user_id""")
def x3(spark, sf):
    source, path = X.scratch(spark, "activity") + "/rows", X.scratch(spark, "state")
    step = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 3600)
    X.table(spark, sf, "events").select(F.col("user_id").alias("feature_id"), step.cast("bigint").alias("step")).repartition(
        3).write.parquet(source)
    stream = jobs.stream_table(spark, source, "feature_id bigint, step bigint")
    jobs.activity_snapshot(stream, path).awaitTermination()
    return jobs.read_activity(spark, path, 720)
