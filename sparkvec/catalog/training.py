"""Objectives."""

from pyspark.sql import functions as F

from ..operators import coding as C
from ..operators import losses as L
from ..operators import metrics as M
from ..plans import suites
from . import inputs as X
from .registry import query

_HAT32 = """
hat AS (SELECT v.vec_id, v.f AS i, max(v.x) AS x, (coalesce(sum(c.h * d.w), 0) + max(b.c))::FLOAT::DOUBLE AS y
        FROM vec v JOIN dbias b ON b.i = v.f LEFT JOIN codes c ON c.vec_id = v.vec_id
        LEFT JOIN dcd d ON d.f = c.f AND d.i = v.f GROUP BY v.vec_id, v.f)"""


@query("T1_recon_loss", f"""WITH {X.sae_sql()}, {_HAT32} SELECT round(avg(1 - c), 6) AS recon FROM (
SELECT sum(x * y) / (greatest(sqrt(sum(x * x)), 1e-8) * greatest(sqrt(sum(y * y)), 1e-8)) AS c FROM hat GROUP BY vec_id)""")
def t1(spark, sf):
    return L.recon_loss(C.forward(X.vectors(spark, sf, "row_idx"), X.coder())).select(X.r6("recon").alias("recon"))


def _batches(spark, sf):
    """Neighbouring vectors as query and positive, in batches of about 64 rows."""
    rows = X.neighbours(spark, sf).select(
        F.col("vec_id").alias("q_idx"), F.col("a").alias("q"), F.col("b").alias("p"))
    return L.assign_batches(rows, "q_idx", X.table(spark, sf, "embeddings").count(), 64)


_BATCH = f"""{X.NEIGHBOURS}, b AS (SELECT *, ('0x' || substr(md5('0:' || vec_id), 1, 15))::BIGINT % greatest(1, round_even((SELECT count(*) FROM embeddings) / 64, 0)::INT) AS batch FROM pairs)"""


def _nce_sql(temperature, scale="1e0"):
    return f"""WITH {_BATCH}, s AS (SELECT q.vec_id, list_dot_product(q.a, d.b) / {scale} / {temperature} AS l, q.vec_id = d.vec_id AS pos
  FROM b q JOIN b d USING (batch))
SELECT round(avg(z - l), 6) AS contrastive FROM (SELECT vec_id, log_z AS z FROM (
  SELECT vec_id, ln(sum(exp(l))) AS log_z FROM s GROUP BY vec_id)) JOIN s USING (vec_id) WHERE pos"""


@query("T5_info_nce", _nce_sql(0.05))
def t5(spark, sf):
    return L.info_nce(_batches(spark, sf)).select(X.r6("contrastive").alias("contrastive"))


@query("T5_info_nce_negatives", f"""WITH {_BATCH}, s AS (
  SELECT q.vec_id, list_dot_product(q.a, d.b) / 0.05 AS l, q.vec_id = d.vec_id AS pos FROM b q JOIN b d USING (batch)
  UNION ALL SELECT q.vec_id, list_dot_product(q.a, n.embedding::DOUBLE[]) / 0.05, false FROM b q JOIN embeddings n ON n.vec_id IN (q.vec_id + 2, q.vec_id + 3))
SELECT round(avg(z - l), 6) AS contrastive FROM (SELECT vec_id, ln(sum(exp(l))) AS z FROM s GROUP BY vec_id) JOIN s USING (vec_id) WHERE pos""")
def t5_neg(spark, sf):
    rows = _batches(spark, sf)
    e = X.vectors(spark, sf, "id")
    neg = e.select((F.col("id") - 2).alias("q_idx"), "embedding").unionByName(
        e.select((F.col("id") - 3).alias("q_idx"), "embedding")).groupBy("q_idx").agg(F.collect_list("embedding").alias("neg"))
    rows = rows.join(neg, "q_idx", "left").withColumn("neg", F.coalesce("neg", F.array().cast("array<array<float>>")))
    return L.info_nce(rows).select(X.r6("contrastive").alias("contrastive"))


@query("T5_info_nce_codes", f"""WITH {X.sae_sql()}, n AS (SELECT count(*) AS n FROM embeddings), b AS (
  SELECT x.vec_id, ('0x' || substr(md5('0:' || x.vec_id), 1, 15))::BIGINT % greatest(1, round_even((SELECT n FROM n) / 64, 0)::INT) AS batch
  FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1),
dots AS (SELECT q.vec_id AS qi, d.vec_id AS di, sum(a.w::DOUBLE * c.w::DOUBLE) AS s FROM b q JOIN b d USING (batch)
  JOIN codes a ON a.vec_id = q.vec_id JOIN codes c ON c.vec_id = d.vec_id + 1 AND c.f = a.f GROUP BY q.vec_id, d.vec_id),
s AS (SELECT q.vec_id, coalesce(s, 0) / 0.05 AS l, q.vec_id = d.vec_id AS pos FROM b q JOIN b d USING (batch)
  LEFT JOIN dots ON qi = q.vec_id AND di = d.vec_id)
SELECT round(avg(z - l), 5) AS contrastive FROM (SELECT vec_id, max(l) + ln(sum(exp(l - m))) AS z FROM s JOIN (
  SELECT vec_id, max(l) AS m FROM s GROUP BY vec_id) USING (vec_id) GROUP BY vec_id) JOIN s USING (vec_id) WHERE pos""")
def t5_codes(spark, sf):
    """The same loss between sparse codes."""
    rows = _batches(spark, sf)
    both = C.encode(C.encode(rows, X.coder(), None, "q", "a"), X.coder(), None, "p", "b")
    loss = L.info_nce(both.select("batch", "q_idx", F.col("a").alias("q"), F.col("b").alias("p")))
    return loss.select(F.round("contrastive", 5).alias("contrastive"))


@query("T13_info_nce_normalised", _nce_sql(
    0.2, "(sqrt(list_dot_product(q.a, q.a)) * sqrt(list_dot_product(d.b, d.b)))"))
def t13_nce(spark, sf):
    return L.info_nce(_batches(spark, sf), 0.2, normalize=True).select(X.r6("contrastive").alias("contrastive"))


@query("T6_distill_loss", f"""WITH {X.sae_sql()}, s AS (SELECT a.vec_id, sum(a.w::DOUBLE * b.w::DOUBLE) AS s FROM codes a
  JOIN codes b ON b.vec_id = a.vec_id + 1 AND b.f = a.f GROUP BY a.vec_id)
SELECT round(avg(pow(coalesce(s, 0) - list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 2)), 6) AS distill
FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 LEFT JOIN s ON s.vec_id = x.vec_id""")
def t6(spark, sf):
    rows = X.neighbours(spark, sf).select(F.col("a").alias("q_emb"), F.col("b").alias("p_emb"))
    both = C.encode(C.encode(rows, X.coder(), None, "q_emb", "q_code"), X.coder(), None, "p_emb", "p_code")
    return L.distill_loss(both).select(X.r6("distill").alias("distill"))


@query("T13_norm_mse", f"""WITH {X.sae_sql()}, {_HAT32} SELECT round(sum(err) / sum(var * n), 6) AS norm_mse FROM (
SELECT i, sum((x - y) * (x - y)) AS err, var_pop(x) AS var, count(*) AS n FROM hat GROUP BY i)""")
def t13(spark, sf):
    return L.norm_mse(C.forward(X.vectors(spark, sf, "row_idx"), X.coder())).select(X.r6("norm_mse").alias("norm_mse"))


# ------------------------------------------------------------------ dead features and combined objectives

def _dead(spark, sf, **kind):
    """Vectors as steps, their eight strongest features as the active ones; dead after 40 steps."""
    codes = C.encode(X.vectors(spark, sf, "step"), X.coder(**kind), 8)
    activity = C.active_features(codes.select("step", "code")).select("step", "feature_id")
    steps = X.table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return L.dead_features(M.steps_since_active(activity, steps, X.DICT), 40)


_AUX = f"""{_HAT32},
steps AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
dead AS (SELECT t.f FROM range({X.DICT}) t(f) LEFT JOIN (SELECT f, max(vec_id) AS s FROM codes WHERE r <= 8 GROUP BY f) l ON l.f = t.f, steps
         WHERE coalesce(n - 1 - s, n) > 40),
aux AS (SELECT vec_id, f, greatest(h, 0) + ln(1 + exp(-abs(h))) AS z FROM (
    SELECT vec_id, f, h, row_number() OVER (PARTITION BY vec_id ORDER BY round(h, 9) DESC, f) AS r FROM pre JOIN dead USING (f)) WHERE r <= 16),
xa AS (SELECT v.vec_id, v.f AS i, coalesce(sum(a.z * d.w), 0) + max(b.c) AS y FROM vec v JOIN dbias b ON b.i = v.f
       LEFT JOIN aux a ON a.vec_id = v.vec_id LEFT JOIN dcd d ON d.f = a.f AND d.i = v.f GROUP BY v.vec_id, v.f),
auxk AS (SELECT vec_id, sum(pow(xa.y - (hat.x - hat.y), 2)) AS e FROM xa JOIN hat USING (vec_id, i) GROUP BY vec_id)"""


@query("T3_auxk_loss", f"WITH {X.sae_sql()}, {_AUX} SELECT round(avg(e), 4) AS auxk, (SELECT count(*) FROM dead) AS dead FROM auxk")
def t3(spark, sf):
    dead = _dead(spark, sf)
    return L.auxk_loss(X.vectors(spark, sf, "row_idx"), X.coder(), dead, 16).select(
        F.round("auxk", 4).alias("auxk"), F.lit(len(dead)).cast("bigint").alias("dead"))


@query("T3_sharded_auxk_loss", f"WITH {X.sae_sql()}, {_AUX} SELECT round(avg(e), 4) AS auxk FROM auxk")
def t3_sharded(spark, sf):
    """The dead features' weights in several pieces."""
    return L.auxk_loss(X.vectors(spark, sf, "row_idx"), X.coder(), _dead(spark, sf), 16, bound=40 * 2 * 4 * X.DIM).select(
        F.round("auxk", 4).alias("auxk"))


_PAIR_TERMS = """
cnt AS (SELECT vec_id, count(*) AS n FROM codes GROUP BY vec_id),
shr AS (SELECT a.vec_id, count(*) AS ns, sum(abs(abs(a.w::DOUBLE) - abs(b.w::DOUBLE))) AS g, sum(a.w::DOUBLE * b.w::DOUBLE) AS s
        FROM codes a JOIN codes b ON b.vec_id = a.vec_id + 1 AND b.f = a.f GROUP BY a.vec_id),
pr AS (SELECT x.vec_id, coalesce(na.n, 0) + coalesce(nb.n, 0) - 2 * coalesce(ns, 0) + 0.5 * coalesce(g, 0) AS al,
              pow(coalesce(s, 0) - list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 2) AS di
       FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 LEFT JOIN shr ON shr.vec_id = x.vec_id
       LEFT JOIN cnt na ON na.vec_id = x.vec_id LEFT JOIN cnt nb ON nb.vec_id = x.vec_id + 1),
bt AS (SELECT vec_id, ('0x' || substr(md5('0:' || vec_id), 1, 15))::BIGINT % greatest(1, round_even((SELECT count(*) FROM pr) / 64, 0)::INT) AS batch FROM pr),
dots AS (SELECT q.vec_id AS qi, d.vec_id AS di, sum(a.w::DOUBLE * c.w::DOUBLE) AS s FROM bt q JOIN bt d USING (batch)
  JOIN codes a ON a.vec_id = q.vec_id JOIN codes c ON c.vec_id = d.vec_id + 1 AND c.f = a.f GROUP BY q.vec_id, d.vec_id),
lg AS (SELECT q.vec_id, coalesce(s, 0) / 0.05 AS l, q.vec_id = d.vec_id AS pos FROM bt q JOIN bt d USING (batch)
  LEFT JOIN dots ON qi = q.vec_id AND di = d.vec_id),
lz AS (SELECT vec_id, max(l) + ln(sum(exp(l - m))) AS z FROM lg JOIN (SELECT vec_id, max(l) AS m FROM lg GROUP BY vec_id) USING (vec_id) GROUP BY vec_id),
nce AS (SELECT avg(z - l) AS contrastive FROM lz JOIN lg USING (vec_id) WHERE pos)"""

_RECON = """rec AS (SELECT vec_id, 1 - sum(x * y) / (greatest(sqrt(sum(x * x)), 1e-8) * greatest(sqrt(sum(y * y)), 1e-8)) AS e FROM hat GROUP BY vec_id)"""


def _totals(total: str) -> str:
    return f"""SELECT round(recon, 5) AS recon, round(align, 5) AS align, round(distill, 5) AS distill, round(auxk, 4) AS auxk,
round(contrastive, 4) AS contrastive, round({total}, 4) AS total FROM means, nce"""


def _regime(name, total, aux=True, **options):
    kind = {"model_type": options.pop("model_type", "sae")}
    if kind["model_type"] == "sae":
        means = "(SELECT avg((a.e + b.e) / 2) FROM pr JOIN rec a USING (vec_id) JOIN rec b ON b.vec_id = pr.vec_id + 1) AS recon"
        means += ", " + ("(SELECT avg((a.e + b.e) / 2) FROM pr JOIN auxk a USING (vec_id) JOIN auxk b ON b.vec_id = pr.vec_id + 1)" if aux else "0e0") + " AS auxk"
        parts = f"{X.sae_sql()}, {_AUX if aux else _HAT32}, {_RECON}"
    else:
        means, parts = "0e0 AS recon, 0e0 AS auxk", X.sae_sql(centred=False)

    @query(name, f"WITH {parts}, {_PAIR_TERMS}, means AS (SELECT avg(al) AS align, avg(di) AS distill, {means} FROM pr) {_totals(total)}")
    def run(spark, sf):
        pairs = X.neighbours(spark, sf).select(F.col("vec_id").alias("row_idx"), F.col("a").alias("q_emb"), F.col("b").alias("p_emb"))
        out = L.combined_losses(pairs, X.coder(**kind), dead=_dead(spark, sf) if aux else None, batch_size=64, auxk_k=16, **options)
        return out.select(*[F.round(c, n).alias(c) for c, n in (("recon", 5), ("align", 5), ("distill", 5), ("auxk", 4), ("contrastive", 4), ("total", 4))])


_regime("T7_stage2_paired", "recon + 0.3 * align + auxk / 32", cache="paired")
_regime("T7_stage2_retrieval", "recon + 0.3 * distill + auxk / 32 + 0.05 * contrastive", cache="retrieval")
_regime("T7_stage3_paired", "contrastive + 0.1 * recon", aux=False, cache="paired", stage=3)
_regime("T7_stage3_retrieval", "contrastive + 0.1 * recon + 0.05 * distill", aux=False, cache="retrieval", stage=3)
_regime("T7_encoder_only", "0.3 * distill + 0.05 * contrastive", aux=False, cache="retrieval", model_type="encoder_only")


@query("T7_schedules", """WITH s AS (SELECT DISTINCT date_diff('hour', TIMESTAMP '2024-01-01', ts)::BIGINT AS step FROM events)
SELECT step, CASE WHEN step >= 500 THEN 32 ELSE greatest(32, round_even(256 + (32 - 256) * (step / 500e0), 0)::INT) END::INTEGER AS linear_k,
CASE WHEN step >= 500 THEN 32 ELSE greatest(32, round_even(32 + (256 - 32) * 0.5e0 * (1 + cos(pi() * (step / 500e0))), 0)::INT) END::INTEGER AS cosine_k,
round(CASE WHEN step < 100 THEN step / 100e0 ELSE 0.5e0 * (1 + cos(pi() * (step - 100) / 620e0)) END, 6) AS rate FROM s""")
def t7_schedules(spark, sf):
    """k and share of the learning rate at every hour of the events as a training step."""
    step = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 3600).cast("bigint")
    s, first = F.col("step"), L.first_k(2048, 32)
    return X.table(spark, sf, "events").select(step.alias("step")).distinct().select(
        "step", L.annealed_k(s, 500, first, 32).alias("linear_k"), L.annealed_k(s, 500, first, 32, "cosine").alias("cosine_k"),
        X.r6(L.learning_rate_share(s, 720, 100)).alias("rate"))
