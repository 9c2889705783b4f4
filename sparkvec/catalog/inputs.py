"""Frames derived from the test tables, next to the SQL that derives them again."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coding as C
from ..operators import relevance as R
from ..operators import search as S
from ..session import ensure_checkpoint_dir

DIM, DICT = 64, 256
RAW_K, SAE_K, TOP = 16, 32, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    path = f"{root}/sparkvec-{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path:
        os.makedirs(path, exist_ok=True)
    return path


def r6(c) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


# ------------------------------------------------------------------ vectors

def vectors(spark, sf_dir, key: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(key), "embedding")


def neighbours(spark, sf_dir) -> DataFrame:
    """Every vector with the one of the next id."""
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.select("vec_id", F.col("embedding").alias("a")).join(b, "vec_id")


NEIGHBOURS = """
pairs AS (SELECT x.vec_id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b
          FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"""

# long form of the vectors: vec_id, f, x (double), w (float)
LONG = """
vec AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS f, unnest(embedding)::FLOAT AS w,
               unnest(embedding)::DOUBLE AS x FROM embeddings)"""


# ------------------------------------------------------------------ raw codes

def raw_codes(spark, sf_dir, key: str, k: int = RAW_K) -> DataFrame:
    return C.raw_topk_encode(vectors(spark, sf_dir, key), k).select(key, "code")


def raw_sql(k: int = RAW_K) -> str:
    return LONG + f""",
codes AS (SELECT vec_id, f, w, r FROM (
    SELECT vec_id, f, w, row_number() OVER (PARTITION BY vec_id ORDER BY abs(w) DESC, f) AS r
    FROM vec) WHERE r <= {k} AND w <> 0)"""


# ------------------------------------------------------------------ closed-form coder

def coder(k: int = SAE_K, model_type: str = "sae", tied: bool = False) -> C.SparseCoder:
    """Weights given by a formula of (feature, component), so SQL can rebuild them."""
    f, i = np.arange(DICT)[:, None], np.arange(DIM)[None, :]
    enc = (((f * 131 + i * 17) % 1009) / 1009.0 - 0.5).astype(np.float32)
    dec = (((f * 37 + i * 29) % 1013) / 1013.0 - 0.5).astype(np.float32)
    return C.SparseCoder(
        enc, ((np.arange(DICT) * 7 % 13) / 100.0).astype(np.float32), dec,
        ((np.arange(DIM) * 5 % 11) / 200.0 - 0.025).astype(np.float32), k, model_type, tied)


CODER = f"""
enc AS (SELECT f, i, (((f*131 + i*17) % 1009) / 1009e0 - 0.5e0)::FLOAT::DOUBLE AS w,
               (((f*7) % 13) / 100e0)::FLOAT::DOUBLE AS b
        FROM range({DICT}) t(f), range({DIM}) u(i)),
dcd AS (SELECT f, i, (((f*37 + i*29) % 1013) / 1013e0 - 0.5e0)::FLOAT::DOUBLE AS w
        FROM range({DICT}) t(f), range({DIM}) u(i)),
dbias AS (SELECT i, (((i*5) % 11) / 200e0 - 0.025e0)::FLOAT::DOUBLE AS c FROM range({DIM}) u(i))"""


def sae_sql(k: int = SAE_K, centred: bool = True) -> str:
    """codes(vec_id, f, w, r) of the closed-form coder on the embeddings."""
    shift = "x - c" if centred else "x"
    return LONG + "," + CODER + f""",
pre AS (SELECT v.vec_id, e.f, sum(({shift}) * e.w) + max(e.b) AS h
        FROM vec v JOIN dbias d ON d.i = v.f JOIN enc e ON e.i = v.f GROUP BY v.vec_id, e.f),
codes AS (SELECT vec_id, f, h::FLOAT AS w, h, r FROM (
    SELECT vec_id, f, h, row_number() OVER (PARTITION BY vec_id ORDER BY round(h, 9) DESC, f) AS r
    FROM pre WHERE h > 0) WHERE r <= {k})"""


def sae_codes(spark, sf_dir, key: str, k: int = SAE_K) -> DataFrame:
    return C.encode(vectors(spark, sf_dir, key), coder(), k).select(key, "code")


# ------------------------------------------------------------------ search and judgments

def search_sql(source: str, scoring: str = "dot", candidates: str = "overlap", epsilon: str = "add",
               top: int = TOP) -> str:
    """run(q_idx, doc_idx, rank, score) of all codes against all codes."""
    scale = {"dot": "1e0", "add": "(nq.n * nd.n + 1e-8)", "clamp": "greatest(nq.n * nd.n, 1e-8)"}[
        "dot" if scoring == "dot" else epsilon]
    norms = "norms AS (SELECT vec_id, sqrt(sum(w::DOUBLE * w::DOUBLE)) AS n FROM codes GROUP BY vec_id)"
    if candidates == "all":
        pairs = """
pairs AS (SELECT q.vec_id AS q_idx, d.vec_id AS doc_idx, coalesce(s.s, 0e0) AS s
          FROM embeddings q CROSS JOIN embeddings d
          LEFT JOIN shared s ON s.q_idx = q.vec_id AND s.doc_idx = d.vec_id)"""
    else:
        pairs = f"""
pairs AS (SELECT q_idx, doc_idx, s / {scale} AS s FROM shared
          JOIN norms nq ON nq.vec_id = q_idx JOIN norms nd ON nd.vec_id = doc_idx)"""
    keep = "WHERE round(s, 9) > 0" if candidates == "positive" else ""
    return source + f""",
{norms},
shared AS (SELECT q.vec_id AS q_idx, d.vec_id AS doc_idx, sum(q.w::DOUBLE * d.w::DOUBLE) AS s
           FROM codes q JOIN codes d ON d.f = q.f GROUP BY q.vec_id, d.vec_id),{pairs},
run AS (SELECT * FROM (
    SELECT q_idx, doc_idx, row_number() OVER (PARTITION BY q_idx ORDER BY round(s, 9) DESC, doc_idx) AS rank,
           s AS score FROM pairs {keep}) WHERE rank <= {top})"""


def dense_sql(top: int = TOP) -> str:
    return f"""
run AS (SELECT * FROM (
    SELECT q_idx, doc_idx, row_number() OVER (PARTITION BY q_idx ORDER BY round(s, 9) DESC, doc_idx) AS rank,
           s AS score FROM (
        SELECT q.vec_id AS q_idx, d.vec_id AS doc_idx,
               list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS s
        FROM embeddings q CROSS JOIN embeddings d)) WHERE rank <= {top})"""


RUN_ROWS = "SELECT q_idx, doc_idx, rank::INTEGER AS rank, round(score, 6) AS score FROM run"


def run_rows(hits: DataFrame) -> DataFrame:
    return hits.select("q_idx", "doc_idx", "rank", r6("score").alias("score"))


def item_rows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_idx"), F.col("vec_id").cast("string").alias("item_id"))


def judgments(spark, sf_dir) -> DataFrame:
    """Order -> part as judgments; the first two lines are judged irrelevant, most ids are outside the pool of vectors."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("qid"), F.col("l_partkey").cast("string").alias("did"),
        (F.col("l_linenumber") - 2).cast("double").alias("rel"))


def relevance(spark, sf_dir) -> DataFrame:
    items = item_rows(spark, sf_dir)
    return R.relevance_rows(judgments(spark, sf_dir), items, items)


RELEVANCE = """
rel AS (SELECT DISTINCT l_orderkey AS q_idx, l_partkey AS doc_idx FROM lineitem
        WHERE l_linenumber > 2 AND l_orderkey IN (SELECT vec_id FROM embeddings)
          AND l_partkey IN (SELECT vec_id FROM embeddings))"""


def raw_run(spark, sf_dir, top: int = TOP) -> DataFrame:
    return S.sparse_search(raw_codes(spark, sf_dir, "q_idx"), raw_codes(spark, sf_dir, "doc_idx"), top)


# ------------------------------------------------------------------ records

def candidates(spark, sf_dir) -> DataFrame:
    """Documents and pages as candidate records with untidy modality strings."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("did"), F.col("text").alias("txt"),
        F.lit(None).cast("string").alias("img_path"),
        F.expr("CASE lang WHEN 'en' THEN ' Text , IMAGE,,' WHEN 'fr' THEN 'TEXT' "
               "WHEN 'de' THEN '  ' END").alias("modality"))
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("did"),
        F.expr("CASE WHEN page_id % 2 = 0 THEN '' ELSE concat('  ', url, ' ') END").alias("txt"),
        F.expr("CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END || replace(url, 'http://', '')").alias("img_path"),
        F.expr("CASE WHEN page_id % 5 = 0 THEN 'image , text' END").alias("modality"))
    return docs.unionByName(pages)


CANDIDATES = """
cand AS (
  SELECT 'd' || doc_id AS did, text AS txt, NULL::VARCHAR AS img_path,
         CASE lang WHEN 'en' THEN ' Text , IMAGE,,' WHEN 'fr' THEN 'TEXT' WHEN 'de' THEN '  ' END AS modality
  FROM documents
  UNION ALL
  SELECT 'p' || page_id, CASE WHEN page_id % 2 = 0 THEN '' ELSE '  ' || url || ' ' END,
         CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END || replace(url, 'http://', ''),
         CASE WHEN page_id % 5 = 0 THEN 'image , text' END
  FROM pages),
modal AS (SELECT *, CASE WHEN trim(coalesce(modality, '')) <> ''
    THEN list_sort(list_distinct(list_filter(list_transform(string_split(lower(modality), ','),
                   lambda x: trim(x)), lambda x: x <> '')))
    ELSE list_sort(list_filter([CASE WHEN coalesce(txt, '') <> '' THEN 'text' END,
                      CASE WHEN coalesce(img_path, '') <> '' THEN 'image' END], lambda x: x IS NOT NULL))
    END AS modes FROM cand),
prompts AS (SELECT *, CASE WHEN list_contains(modes, 'text')
    THEN coalesce(trim(txt, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), '') ELSE '' END AS body,
    CASE WHEN list_contains(modes, 'image') AND coalesce(img_path, '') <> ''
         THEN CASE WHEN img_path LIKE '/%' THEN img_path ELSE '/data/' || img_path END END AS image_path
    FROM modal)"""
