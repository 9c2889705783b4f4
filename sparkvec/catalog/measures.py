"""Ranking metrics, suites and reports."""

import math

from pyspark.sql import functions as F

from ..operators import coding as C
from ..operators import losses as L
from ..operators import metrics as M
from ..plans import suites
from ..session import cut_lineage
from ..sources import stores
from . import inputs as X
from .registry import query

IDEAL = "[" + ", ".join(f"{sum(1 / math.log2(j + 1) for j in range(1, i + 1))!r}" for i in range(1, 11)) + "]"


def metrics_sql(runs: str, relevance: str = X.RELEVANCE) -> str:
    """`scores` with one row per (method, k) of `runs(method, k, q_idx, doc_idx, rank)`."""
    cuts = M.CUTS
    return f"""{relevance},
sizes AS (SELECT q_idx, count(*) AS n_rel FROM rel GROUP BY q_idx),
tot AS (SELECT count(*) AS nq, sum(n_rel) AS rel FROM sizes),
{runs},
perq AS (SELECT method, k, q_idx, {', '.join(f'sum((rank <= {c})::INT) AS h{c}' for c in cuts)},
         min(rank) AS fr, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
         FROM runs JOIN rel USING (q_idx, doc_idx) GROUP BY method, k, q_idx),
scores AS (SELECT m.method, m.k::INTEGER AS k,
  {', '.join(f'coalesce(sum(h{c}), 0) / greatest(max(t.rel), 1) AS recall_at_{c}' for c in cuts)},
  {', '.join(f'coalesce(sum((fr <= {c})::INT), 0) / max(t.nq) AS hit_rate_at_{c}' for c in cuts)},
  coalesce(sum(1 / fr), 0) / max(t.nq) AS mrr,
  coalesce(sum(dcg / greatest({IDEAL}[least(n_rel, 10)], 1e-8)), 0) / max(t.nq) AS ndcg_at_10
  FROM (SELECT DISTINCT method, k FROM runs) m CROSS JOIN tot t
  LEFT JOIN perq p ON p.method = m.method AND p.k = m.k LEFT JOIN sizes s ON s.q_idx = p.q_idx
  GROUP BY m.method, m.k),
long AS (SELECT method, k, metric, value FROM scores UNPIVOT (value FOR metric IN
  ({', '.join(M.METRICS)})))"""


_RAW = f"{X.search_sql(X.raw_sql())}, {metrics_sql(f'runs AS (SELECT {chr(39)}raw{chr(39)} AS method, {X.RAW_K} AS k, * FROM run)')}"


def _raw_metrics(spark, sf):
    run = suites.as_run(X.raw_run(spark, sf), "raw", X.RAW_K)
    return M.ranking_metrics(run, cut_lineage(X.relevance(spark, sf)))


def _columns(name, columns):
    listed = ", ".join(f"round({c}, 6) AS {c}" for c in columns)

    @query(name, f"WITH {_RAW} SELECT method, k, {listed} FROM scores")
    def run(spark, sf):
        return _raw_metrics(spark, sf).select("method", "k", *[X.r6(c).alias(c) for c in columns])


_columns("M1_recall", [f"recall_at_{c}" for c in M.CUTS])
_columns("M2_hit_rate", [f"hit_rate_at_{c}" for c in M.CUTS])
_columns("M3_mrr", ["mrr"])
_columns("M4_ndcg", ["ndcg_at_10"])

_LONG = "SELECT method, k, metric, round(value, 6) AS value FROM long"


def _long(metrics):
    return M.long_form(metrics).select("method", "k", "metric", X.r6("value").alias("value"))


@query("M5_metric_bundle", f"WITH {_RAW} {_LONG}")
def m5(spark, sf):
    return _long(_raw_metrics(spark, sf))


@query("M1_macro_recall", f"""WITH {X.search_sql(X.raw_sql())}, {X.RELEVANCE},
s AS (SELECT q_idx, count(*) AS n FROM rel GROUP BY q_idx),
h AS (SELECT q_idx, count(*) AS h FROM run JOIN rel USING (q_idx, doc_idx) GROUP BY q_idx)
SELECT 'raw' AS method, {X.RAW_K} AS k, round(sum(h / n) / (SELECT count(*) FROM s), 6) AS macro_recall_at_100
FROM h JOIN s USING (q_idx)""")
def m1_macro(spark, sf):
    run = suites.as_run(X.raw_run(spark, sf), "raw", X.RAW_K)
    return M.macro_recall(run, cut_lineage(X.relevance(spark, sf)), 100).select(
        "method", "k", X.r6("macro_recall_at_100").alias("macro_recall_at_100"))


def _frames(spark, sf):
    """Query and document vectors, and the relevance, which is stored: metrics read it several times."""
    return X.vectors(spark, sf, "q_idx"), X.vectors(spark, sf, "doc_idx"), cut_lineage(X.relevance(spark, sf))


@query("M6_reconstruction", f"""WITH {X.sae_sql()},
hat AS (SELECT v.vec_id, v.f AS i, max(v.x) AS x,
        (coalesce(sum(c.h * d.w), 0) + max(b.c))::FLOAT::DOUBLE AS y
        FROM vec v JOIN dbias b ON b.i = v.f LEFT JOIN codes c ON c.vec_id = v.vec_id
        LEFT JOIN dcd d ON d.f = c.f AND d.i = v.f GROUP BY v.vec_id, v.f),
per AS (SELECT vec_id, sum(x * y) / (greatest(sqrt(sum(x * x)), 1e-8) * greatest(sqrt(sum(y * y)), 1e-8)) AS c,
        sqrt(sum((x - y) * (x - y))) AS l FROM hat GROUP BY vec_id)
SELECT round(avg(c), 6) AS mean_cosine, round(stddev_pop(c), 6) AS std_cosine, round(avg(l), 5) AS mean_l2,
       round(stddev_pop(l), 5) AS std_l2 FROM per""")
def m6(spark, sf):
    out = suites.reconstruction(X.vectors(spark, sf, "row_idx"), X.coder(), X.SAE_K)
    return out.select(X.r6("mean_cosine").alias("mean_cosine"), X.r6("std_cosine").alias("std_cosine"),
                      F.round("mean_l2", 5).alias("mean_l2"), F.round("std_l2", 5).alias("std_l2"))


_ALIGN = f"""{X.sae_sql()},
both_ AS (SELECT a.vec_id, a.f, a.w::DOUBLE AS x, b.w::DOUBLE AS y FROM codes a
          JOIN codes b ON b.vec_id = a.vec_id + 1 AND b.f = a.f),
size AS (SELECT vec_id, count(*) AS n, sqrt(sum(w::DOUBLE * w::DOUBLE)) AS norm FROM codes GROUP BY vec_id),
per AS (SELECT x.vec_id, x.n AS na, y.n AS nb, x.norm AS qa, y.norm AS qb,
        (SELECT count(*) FROM both_ b WHERE b.vec_id = x.vec_id) AS ns,
        (SELECT coalesce(sum(b.x * b.y), 0) FROM both_ b WHERE b.vec_id = x.vec_id) AS s,
        (SELECT coalesce(sum(abs(abs(b.x) - abs(b.y))), 0) FROM both_ b WHERE b.vec_id = x.vec_id) AS g,
        list_dot_product(ex.embedding::DOUBLE[], ey.embedding::DOUBLE[]) AS dense,
        list_dot_product(ex.embedding::DOUBLE[], ex.embedding::DOUBLE[]) AS dx,
        list_dot_product(ey.embedding::DOUBLE[], ey.embedding::DOUBLE[]) AS dy
        FROM size x JOIN size y ON y.vec_id = x.vec_id + 1
        JOIN embeddings ex ON ex.vec_id = x.vec_id JOIN embeddings ey ON ey.vec_id = y.vec_id)"""


def _pairs(spark, sf):
    return X.neighbours(spark, sf).select(
        F.col("vec_id").alias("row_idx"), F.col("a").alias("image_emb"), F.col("b").alias("text_emb"))


@query("M7_alignment", f"""WITH {_ALIGN}, m AS (SELECT avg(ns / (na + nb - ns + 1e-8)) AS j,
  avg(s / (greatest(qa, 1e-8) * greatest(qb, 1e-8))) AS s,
  avg(dense / (greatest(sqrt(dx), 1e-8) * greatest(sqrt(dy), 1e-8))) AS d FROM per)
SELECT round(j, 6) AS jaccard, round(s, 6) AS sparse_cosine, round(d, 6) AS dense_cosine,
       round(s / greatest(d, 1e-8), 2) AS retention FROM m""")
def m7(spark, sf):
    out = suites.alignment(_pairs(spark, sf), X.coder(), X.SAE_K)
    return out.select(*[X.r6(c).alias(c) for c in ("jaccard", "sparse_cosine", "dense_cosine")],
                      F.round("retention", 2).alias("retention"))


@query("T2_align_loss", f"WITH {_ALIGN} SELECT round(avg(na + nb - 2 * ns) + 0.5 * avg(g), 6) AS align FROM per")
def t2(spark, sf):
    both = C.encode(C.encode(_pairs(spark, sf), X.coder(), X.SAE_K, "image_emb", "a"),
                    X.coder(), X.SAE_K, "text_emb", "b")
    out = L.align_loss(both.select("row_idx", F.col("a").alias("code")), both.select("row_idx", F.col("b").alias("code")))
    return out.select(X.r6("align").alias("align"))


_SPARSE_RUN = X.search_sql(X.sae_sql(), candidates="positive").replace("run AS", "srun AS")
_DENSE_RUN = X.dense_sql().replace("run AS", "drun AS")
_BOTH_RUNS = ",".join([_SPARSE_RUN, _DENSE_RUN, metrics_sql(f"""runs AS (
SELECT 'sparse' AS method, {X.SAE_K} AS k, * FROM srun UNION ALL SELECT 'dense', 0, * FROM drun)""")])


@query("M8_sparse_vs_dense", f"WITH {_BOTH_RUNS} {_LONG}")
def m8(spark, sf):
    metrics, _, _ = suites.sparse_vs_dense(*_frames(spark, sf), X.coder(), X.SAE_K)
    return _long(metrics)


@query("M8_stage_times", f"""SELECT method, k::INTEGER AS k, stage, true AS timed FROM (VALUES ('sparse', {X.SAE_K}, 'encode_queries'),
('sparse', {X.SAE_K}, 'encode_docs'), ('sparse', {X.SAE_K}, 'search'), ('dense', 0, 'search')) t(method, k, stage)""")
def m8_times(spark, sf):
    """Every stage was timed; the seconds themselves differ from run to run."""
    _, stats, times = suites.sparse_vs_dense(*_frames(spark, sf), X.coder(), X.SAE_K)
    return times.select("method", "k", "stage", ((F.col("seconds") >= 0) & (F.col("speedup") > 0)).alias("timed"))


@query("M9_retention", f"""WITH {_BOTH_RUNS} SELECT s.method, s.k, s.metric, round(s.value / greatest(d.value, 1e-8), 5) AS retention
FROM long s JOIN long d ON d.metric = s.metric AND d.method = 'dense' WHERE s.method <> 'dense'""")
def m9(spark, sf):
    q, d, rel = _frames(spark, sf)
    runs = suites.sparse_sweep(q, d, X.coder(), [X.SAE_K]).unionByName(suites.dense_run(q, d))
    kept = M.retention(M.long_form(M.ranking_metrics(runs, rel)))
    return kept.select("method", "k", "metric", F.round("retention", 5).alias("retention"))


def _sweep_sql(ks):
    """Every k from the ranks of the widest code; k over the dictionary size is skipped."""
    ks = [k for k in ks if k <= X.DICT]
    return f"""{X.sae_sql(max(ks))},
cut AS (SELECT k.k, c.* FROM codes c JOIN (SELECT unnest({ks}) AS k) k ON c.r <= k.k),
s AS (SELECT q.k, q.vec_id AS q_idx, d.vec_id AS doc_idx, sum(q.w::DOUBLE * d.w::DOUBLE) AS s
      FROM cut q JOIN cut d ON d.k = q.k AND d.f = q.f WHERE q.vec_id IN (SELECT q_idx FROM rel)
      GROUP BY q.k, q.vec_id, d.vec_id),
runs AS (SELECT 'sparse' AS method, * FROM (SELECT k, q_idx, doc_idx, row_number() OVER (
      PARTITION BY k, q_idx ORDER BY round(s, 9) DESC, doc_idx) AS rank FROM s WHERE round(s, 9) > 0) WHERE rank <= 100)"""


@query("M10_sparsity_trade_off", f"WITH {metrics_sql(_sweep_sql(suites.TRADE_OFF_KS))} {_LONG}")
def m10(spark, sf):
    q, d, rel = _frames(spark, sf)
    return _long(M.ranking_metrics(suites.sparse_sweep(suites.judged(q, rel), d, X.coder(), suites.TRADE_OFF_KS), rel))


@query("M11_sparse_k_suite", f"WITH {metrics_sql(_sweep_sql((16, 32, 64)))} {_LONG}")
def m11(spark, sf):
    q, d, rel = _frames(spark, sf)
    return _long(M.ranking_metrics(suites.sparse_sweep(suites.judged(q, rel), d, X.coder(), (16, 32, 64)), rel))


@query("M11_index_stats_by_k", f"""WITH {X.sae_sql(64)}, cut AS (
  SELECT k.k, c.f, count(*) AS n FROM codes c JOIN (SELECT unnest([16, 32, 64]) AS k) k ON c.r <= k.k GROUP BY k.k, c.f)
SELECT k::INTEGER AS k, count(*)::BIGINT AS features_used, round(avg(n), 6) AS avg_posting_length,
  round(sum(n) / (SELECT count(*) FROM embeddings), 6) AS avg_doc_length FROM cut GROUP BY k""")
def m11_stats(spark, sf):
    out = suites.sweep_stats(X.vectors(spark, sf, "doc_idx"), X.coder(), (16, 32, 64))
    return out.select("k", "features_used", X.r6("avg_posting_length").alias("avg_posting_length"),
                      X.r6("avg_doc_length").alias("avg_doc_length"))


@query("M12_raw_topk_suite", f"""WITH {X.search_sql(X.raw_sql(), candidates='all')},
{metrics_sql(f"runs AS (SELECT 'raw_topk' AS method, {X.RAW_K} AS k, * FROM run)")} {_LONG}""")
def m12(spark, sf):
    q, d, rel = _frames(spark, sf)
    return _long(M.ranking_metrics(suites.raw_topk_run(suites.judged(q, rel), d, X.RAW_K), rel))


@query("M12_raw_topk_sweep", f"""WITH {X.raw_sql(32)}, ks AS (SELECT unnest([4, 16, 32]) AS k),
shk AS (SELECT k, q.vec_id AS q_idx, d.vec_id AS doc_idx, sum(q.w::DOUBLE * d.w::DOUBLE) AS s FROM ks JOIN codes q ON q.r <= k
        JOIN codes d ON d.f = q.f AND d.r <= k GROUP BY ALL),
{metrics_sql(f"""runs AS (SELECT * FROM (SELECT 'raw_topk' AS method, ks.k, q.vec_id AS q_idx, d.vec_id AS doc_idx,
    row_number() OVER (PARTITION BY ks.k, q.vec_id ORDER BY round(coalesce(s, 0e0), 9) DESC, d.vec_id) AS rank
    FROM ks CROSS JOIN embeddings q CROSS JOIN embeddings d
    LEFT JOIN shk ON shk.k = ks.k AND shk.q_idx = q.vec_id AND shk.doc_idx = d.vec_id) WHERE rank <= {X.TOP})""")} {_LONG}""")
def m12_sweep(spark, sf):
    """Three sizes of raw codes from one encoding and one pass."""
    q, d, rel = _frames(spark, sf)
    return _long(M.ranking_metrics(suites.raw_topk_sweep(suites.judged(q, rel), d, (4, 16, 32)), rel))


_CENTRED_RUN = f"""mean AS (SELECT f, avg(x) AS m FROM vec GROUP BY f),
centred AS (SELECT vec_id, list((x - m)::FLOAT::DOUBLE ORDER BY f) AS v FROM vec JOIN mean USING (f) GROUP BY vec_id),
run AS (SELECT * FROM (SELECT q_idx, doc_idx, row_number() OVER (PARTITION BY q_idx ORDER BY round(s, 9) DESC, doc_idx) AS rank
    FROM (SELECT a.vec_id AS q_idx, b.vec_id AS doc_idx, list_dot_product(a.v, b.v) AS s FROM centred a CROSS JOIN centred b))
    WHERE rank <= {X.TOP})"""


@query("M13_pca_identity_suite", f"""WITH {X.LONG}, {_CENTRED_RUN},
{metrics_sql(f"runs AS (SELECT 'pca' AS method, {X.DIM // 2} AS k, * FROM run)")} {_LONG}""")
def m13_identity(spark, sf):
    """At a memory of all dimensions nothing is reduced, but vectors are still centred."""
    q, d, rel = _frames(spark, sf)
    return _long(M.ranking_metrics(suites.pca_run(suites.judged(q, rel), d, X.DIM // 2), rel))


@query("M13_pca_identity_sweep", f"""WITH {X.LONG}, {_CENTRED_RUN},
{metrics_sql(f"runs AS (SELECT 'pca' AS method, k, run.* FROM run, (SELECT unnest([{X.DIM // 2}, {X.DIM // 2 + 9}]) AS k))")} {_LONG}""")
def m13_identity_sweep(spark, sf):
    """Sizes that reach the full dimension next to a reduced one, from one fit and one pass; the reduced one is left out here."""
    q, d, rel = _frames(spark, sf)
    metrics = M.ranking_metrics(suites.pca_sweep(suites.judged(q, rel), d, (4, X.DIM // 2, X.DIM // 2 + 9)), rel)
    return _long(metrics.where("k > 4"))


@query("M13_pca_suite")
def m13(spark, sf):
    q, d, rel = _frames(spark, sf)
    return _long(M.ranking_metrics(suites.pca_run(suites.judged(q, rel), d, 16), rel))


_AE = """
proj AS (SELECT vec_id, o, sum(x * aw) + max(b) AS z FROM vec JOIN (
    SELECT o, i, (((o*41 + i*13) % 997) / 997e0 - 0.5e0)::FLOAT::DOUBLE AS aw, ((o % 7) / 50e0)::FLOAT::DOUBLE AS b
    FROM range(32) t(o), range(64) u(i)) ON i = f GROUP BY vec_id, o),
lat AS (SELECT vec_id, o, (z / greatest(n, 1e-8))::FLOAT AS w FROM proj JOIN (
    SELECT vec_id, sqrt(sum(z * z)) AS n FROM proj GROUP BY vec_id) USING (vec_id)),
latv AS (SELECT vec_id, list(w::DOUBLE ORDER BY o) AS v FROM lat GROUP BY vec_id),
run AS (SELECT * FROM (SELECT q_idx, doc_idx, row_number() OVER (PARTITION BY q_idx ORDER BY round(s, 9) DESC, doc_idx) AS rank
    FROM (SELECT a.vec_id AS q_idx, b.vec_id AS doc_idx, list_dot_product(a.v, b.v) AS s FROM latv a CROSS JOIN latv b))
    WHERE rank <= 100)"""


def linear_ae() -> C.DenseAE:
    import numpy as np
    o, i = np.arange(32)[:, None], np.arange(X.DIM)[None, :]
    enc = (((o * 41 + i * 13) % 997) / 997.0 - 0.5).astype(np.float32)
    return C.DenseAE([(enc, (np.arange(32) % 7 / 50.0).astype(np.float32))],
                     [(enc.T.copy(), np.zeros(X.DIM, np.float32))])


@query("M15_stored_ae_suite", f"""WITH {X.LONG}, {_AE}, {metrics_sql("runs AS (SELECT 'dense_ae' AS method, 16 AS k, * FROM run)")} {_LONG}""")
def m15(spark, sf):
    path = X.scratch(spark, "ae")
    stores.write_dense_ae(linear_ae(), spark, path)
    q, d, rel = _frames(spark, sf)
    run, _ = suites.stored_ae_run(suites.judged(q, rel), d, stores.read_dense_ae(spark, path), requested=[16])
    return _long(M.ranking_metrics(run, rel))


@query("M16_matched_k", f"""WITH {metrics_sql(_sweep_sql((16, 32, 64)))}
SELECT k::INTEGER AS k FROM long WHERE metric = 'recall_at_100' ORDER BY value DESC, k LIMIT 1""")
def m16(spark, sf):
    q, d, rel = _frames(spark, sf)
    scored = M.long_form(M.ranking_metrics(suites.sparse_sweep(suites.judged(q, rel), d, X.coder(), (16, 32, 64)), rel))
    return M.matched_k(scored, "best", "recall_at_100")


@query("M16_matched_all", f"WITH {metrics_sql(_sweep_sql((16, 32, 64)))} SELECT DISTINCT k::INTEGER AS k FROM long")
def m16_all(spark, sf):
    q, d, rel = _frames(spark, sf)
    scored = M.long_form(M.ranking_metrics(suites.sparse_sweep(suites.judged(q, rel), d, X.coder(), (16, 32, 64)), rel))
    return M.matched_k(scored, "all")


@query("M16_matched_primary", f"WITH {metrics_sql(_sweep_sql((16, 32, 64)))} SELECT DISTINCT k::INTEGER AS k FROM long WHERE k = 64")
def m16_primary(spark, sf):
    q, d, rel = _frames(spark, sf)
    scored = M.long_form(M.ranking_metrics(suites.sparse_sweep(suites.judged(q, rel), d, X.coder(), (64, 16, 32)), rel))
    return M.matched_k(scored, "primary", primary=64)


@query("K4_trec_run", f"""WITH {X.search_sql(X.raw_sql())} SELECT q_idx || ' Q0 ' || doc_idx || ' ' || rank || ' '
|| printf('%.6f', 1 / rank::DOUBLE) || ' raw' AS line FROM run""")
def k4(spark, sf):
    path = X.scratch(spark, "trec")
    run = X.raw_run(spark, sf).withColumn("qid", F.col("q_idx").cast("string")).withColumn(
        "did", F.col("doc_idx").cast("string"))
    stores.write_trec(run, path, "raw")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("K5_report", f"WITH {_RAW} SELECT method, k, metric, round(value, 6) AS value FROM long")
def k5(spark, sf):
    """The JSON report written and read back as rows."""
    path = X.scratch(spark, "report")
    times = spark.createDataFrame([("raw", X.RAW_K, "search", 0.0)], "method string, k int, stage string, seconds double")
    stores.write_report(M.long_form(_raw_metrics(spark, sf)), times, path, corpus="embeddings")
    schema = "methods array<struct<method: string, primary_k: int, suite: array<struct<k: int, metrics: array<struct<metric: string, value: double>>>>>>"
    r = spark.read.text(f"{path}/report").select(F.from_json("value", schema).alias("r"))
    r = r.select(F.explode("r.methods").alias("m")).select("m.method", F.explode("m.suite").alias("s"))
    return r.select("method", F.col("s.k").alias("k"), F.explode("s.metrics").alias("m")).select(
        "method", "k", F.col("m.metric").alias("metric"), X.r6("m.value").alias("value"))


@query("W4_running_gap", """WITH a AS (SELECT DISTINCT user_id AS feature_id, (date_diff('hour', TIMESTAMP '2024-01-01', ts))::BIGINT AS step,
  event_type = 'purchase' AS active FROM events),
b AS (SELECT feature_id, step, bool_or(active) AS active FROM a GROUP BY ALL)
SELECT feature_id, step, coalesce(step - max(CASE WHEN active THEN step END) OVER (PARTITION BY feature_id ORDER BY step), step + 1) AS gap FROM b""")
def w4(spark, sf):
    return M.running_gap(_activity(spark, sf, False))


def _activity(spark, sf, active_only: bool = True):
    """Users as features, hours as steps."""
    step = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 3600)
    rows = X.table(spark, sf, "events").groupBy(
        F.col("user_id").alias("feature_id"), step.cast("bigint").alias("step")).agg(
        F.bool_or(F.col("event_type") == "purchase").alias("active"))
    return rows.where("active") if active_only else rows


@query("T4_dead_fraction", """WITH a AS (SELECT user_id AS feature_id, max(date_diff('hour', TIMESTAMP '2024-01-01', ts)) AS last
  FROM events WHERE event_type = 'purchase' GROUP BY user_id),
g AS (SELECT coalesce(719 - a.last, 720) AS gap FROM (SELECT DISTINCT user_id AS f FROM events) r LEFT JOIN a ON a.feature_id = r.f)
SELECT avg((gap > 24)::INT) AS dead_fraction FROM g""")
def t4(spark, sf):
    users = X.table(spark, sf, "events").select(F.col("user_id").alias("feature_id")).distinct()
    return M.dead_fraction(M.steps_since_active(_activity(spark, sf), 720, users), 24)


_RAW_32 = """
rcodes AS (SELECT vec_id, f, w FROM (SELECT vec_id, f, w, row_number() OVER (PARTITION BY vec_id ORDER BY abs(w) DESC, f) AS r
    FROM vec) WHERE r <= 32 AND w <> 0),
rshared AS (SELECT q.vec_id AS q_idx, d.vec_id AS doc_idx, sum(q.w::DOUBLE * d.w::DOUBLE) AS s
    FROM rcodes q JOIN rcodes d ON d.f = q.f GROUP BY ALL),
rpairs AS (SELECT q.vec_id AS q_idx, d.vec_id AS doc_idx, coalesce(s.s, 0e0) AS s FROM embeddings q CROSS JOIN embeddings d
    LEFT JOIN rshared s ON s.q_idx = q.vec_id AND s.doc_idx = d.vec_id),
rrun AS (SELECT * FROM (SELECT q_idx, doc_idx, row_number() OVER (PARTITION BY q_idx ORDER BY round(s, 9) DESC, doc_idx) AS rank,
    s AS score FROM rpairs) WHERE rank <= 100)"""
_ALL_RUNS = ",".join([_SPARSE_RUN, _DENSE_RUN, _RAW_32, metrics_sql(f"""runs AS (
SELECT 'sparse' AS method, {X.SAE_K} AS k, * FROM srun UNION ALL SELECT 'dense', 0, * FROM drun
UNION ALL SELECT 'raw_topk', {X.SAE_K}, * FROM rrun)""")])


@query("M17_benchmark_job", f"WITH {_ALL_RUNS} {_LONG}")
def m17(spark, sf):
    """Dense, sparse and raw methods on the same judged queries."""
    _, metrics, _ = suites.benchmark(*_frames(spark, sf), [X.SAE_K], X.coder(), baselines=("raw_topk",))
    return _long(metrics)


@query("T11_select_coder", f"""WITH {metrics_sql(_sweep_sql((4, 16, 32)))}, c AS (SELECT * FROM (VALUES
  (0, 'small', 4), (1, 'large', 32), (2, 'large again', 32), (3, 'middle', 16)) t(place, coder, k)),
v AS (SELECT place::INTEGER AS place, coder, coalesce(ndcg_at_10, 0) AS value FROM c LEFT JOIN scores USING (k))
SELECT place, coder, round(value, 6) AS value, place = (SELECT arg_max(place, (round(value, 12), -place)) FROM v) AS chosen FROM v""")
def t11(spark, sf):
    """Four stored coders, two of them alike, scored in one pass."""
    q, d, rel = _frames(spark, sf)
    coders = {"small": X.coder(4), "large": X.coder(32), "large again": X.coder(32), "middle": X.coder(16)}
    return suites.select_coder(q, d, rel, coders).select("place", "coder", X.r6("value").alias("value"), "chosen")
