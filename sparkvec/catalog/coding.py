"""Sparse and compressed coding."""

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import coding as C
from ..operators import search as S
from ..sources import stores
from . import inputs as X
from .measures import linear_ae
from .registry import query

_ROWS = "SELECT vec_id, f::INTEGER AS feature_id, r::INTEGER AS code_rank, round(w::DOUBLE, 6) AS weight FROM codes"


def _rows(codes):
    return C.active_features(codes).select(
        "vec_id", "feature_id", "code_rank", X.r6(F.col("weight").cast("double")).alias("weight"))


def _code(spark, sf, k=X.SAE_K, **kind):
    return C.encode(X.vectors(spark, sf, "vec_id"), X.coder(**kind), k).select("vec_id", "code")


@query("C1_topk_encode", f"WITH {X.sae_sql()} {_ROWS}")
def c1(spark, sf):
    return _rows(_code(spark, sf))


@query("C2_encoder_only", f"WITH {X.sae_sql(centred=False)} {_ROWS}")
def c2(spark, sf):
    return _rows(_code(spark, sf, model_type="encoder_only"))


@query("C1_tied_encode", f"WITH {X.sae_sql(centred=False)} {_ROWS}")
def c1_tied(spark, sf):
    return _rows(_code(spark, sf, tied=True))


@query("C3_active_features", f"WITH {X.sae_sql(8)} {_ROWS}")
def c3(spark, sf):
    return _rows(_code(spark, sf, 8))


@query("C4_bulk_codes", f"WITH {X.sae_sql(X.DICT)} SELECT vec_id, count(*)::INTEGER AS n, round(sum(w::DOUBLE), 4) AS total FROM codes GROUP BY vec_id")
def c4(spark, sf):
    """With k at the dictionary size a code is every positive activation, never more than k."""
    code = _code(spark, sf, X.DICT)
    return code.select("vec_id", F.size("code").alias("n"), F.round(F.aggregate(
        "code", F.lit(0.0), lambda a, e: a + e["weight"].cast("double")), 4).alias("total"))


@query("Z7_nested_codes", f"WITH {X.sae_sql(8)} {_ROWS}")
def z7(spark, sf):
    """The k=8 code as a prefix of the k=32 code."""
    return _rows(_code(spark, sf).withColumn("code", V.keep_top("code", 8)))


_HAT = """
hat AS (SELECT v.vec_id, v.f AS i, (coalesce(sum(c.w::DOUBLE * d.w), 0) + max(b.c)) AS y
        FROM vec v JOIN dbias b ON b.i = v.f LEFT JOIN codes c ON c.vec_id = v.vec_id
        LEFT JOIN dcd d ON d.f = c.f AND d.i = v.f GROUP BY v.vec_id, v.f)"""


def _vector_rows(df, column, places=5):
    return df.select("vec_id", F.posexplode(column).alias("pos", "x")).select(
        "vec_id", "pos", F.round(F.col("x").cast("double"), places).alias("x"))


@query("C6_decode", f"WITH {X.sae_sql()}, {_HAT} SELECT vec_id, i::INTEGER AS pos, round(y::FLOAT::DOUBLE, 5) AS x FROM hat")
def c6(spark, sf):
    return _vector_rows(C.decode(_code(spark, sf), X.coder()), "x_hat")


@query("C6_decode_tied", f"""WITH {X.sae_sql(centred=False)}, hat AS (SELECT c.vec_id, e.i, sum(c.w::DOUBLE * e.w) AS y
  FROM codes c JOIN enc e ON e.f = c.f GROUP BY c.vec_id, e.i) SELECT vec_id, i::INTEGER AS pos, round(y::FLOAT::DOUBLE, 5) AS x FROM hat""")
def c6_tied(spark, sf):
    return _vector_rows(C.decode(_code(spark, sf, tied=True), X.coder(tied=True)), "x_hat")


@query("C6_decode_join", f"WITH {X.sae_sql()}, {_HAT} SELECT vec_id, i::INTEGER AS pos, round(y, 5) AS x FROM hat")
def c6_join(spark, sf):
    """Decoding as a join of code entries and stored weight rows, for dictionaries kept as a table."""
    weights, meta = X.coder().to_frames(spark)
    entries = C.active_features(_code(spark, sf)).join(
        weights.select("feature_id", "dec"), "feature_id").select("vec_id", "weight", F.posexplode("dec").alias("pos", "d"))
    bias = meta.select(F.posexplode("dec_bias").alias("pos", "c"))
    return entries.groupBy("vec_id", "pos").agg(
        F.sum(F.col("weight").cast("double") * F.col("d").cast("double")).alias("y")).join(
        F.broadcast(bias), "pos").select("vec_id", "pos", F.round(F.col("y") + F.col("c").cast("double"), 5).alias("x"))


@query("C7_forward", f"""WITH {X.sae_sql()}, p AS (SELECT vec_id, sum((h > 0)::INT) AS n FROM pre GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM codes c WHERE c.vec_id = p.vec_id)::INTEGER AS active_dims, n::INTEGER AS positive_pre FROM p""")
def c7(spark, sf):
    return C.forward(X.vectors(spark, sf, "vec_id"), X.coder()).select("vec_id", "active_dims", "positive_pre")


_FORWARD = f"""WITH {X.sae_sql()}, p AS (SELECT vec_id, sum((h > 0)::INT) AS n FROM pre GROUP BY vec_id), {_HAT.replace('c.w::DOUBLE', 'c.h')}
SELECT vec_id, (SELECT count(*) FROM codes c WHERE c.vec_id = p.vec_id)::INTEGER AS active_dims, n::INTEGER AS positive_pre,
i::INTEGER AS pos, round(y::FLOAT::DOUBLE, 5) AS x FROM p JOIN hat USING (vec_id)"""


def _forward_rows(df):
    return df.select("vec_id", "active_dims", "positive_pre", F.posexplode("x_hat").alias("pos", "x")).select(
        "vec_id", "active_dims", "positive_pre", "pos", F.round(F.col("x").cast("double"), 5).alias("x"))


@query("C7_sharded_forward", _FORWARD)
def c7_sharded(spark, sf):
    """A coder over the bound: pieces of 60 features, each broadcast by itself."""
    return _forward_rows(C.forward(X.vectors(spark, sf, "vec_id"), X.coder(), bound=60 * 2 * 4 * X.DIM))


@query("C7_stored_forward", _FORWARD)
def c7_stored(spark, sf):
    """The same from the stored weight table, which is never whole on the driver."""
    path = X.scratch(spark, "stored-coder")
    stores.write_weights(X.coder(), spark, path, label="closed form")
    return _forward_rows(C.forward(X.vectors(spark, sf, "vec_id"), stores.stored_coder(spark, path), bound=60 * 2 * 4 * X.DIM))


@query("C6_sharded_decode_tied", f"""WITH {X.sae_sql(centred=False)}, hat AS (SELECT c.vec_id, e.i, sum(c.w::DOUBLE * e.w) AS y
  FROM codes c JOIN enc e ON e.f = c.f GROUP BY c.vec_id, e.i) SELECT vec_id, i::INTEGER AS pos, round(y::FLOAT::DOUBLE, 5) AS x FROM hat""")
def c6_sharded_tied(spark, sf):
    return _vector_rows(C.decode(_code(spark, sf, tied=True), X.coder(tied=True), bound=60 * 4 * X.DIM), "x_hat")


@query("C8_raw_topk", f"WITH {X.raw_sql()} {_ROWS}")
def c8(spark, sf):
    return _rows(X.vectors(spark, sf, "vec_id").select("vec_id", V.raw_topk("embedding", X.RAW_K).alias("code")))


@query("C8_raw_topk_bulk", f"WITH {X.raw_sql()} {_ROWS}")
def c8_bulk(spark, sf):
    return _rows(X.raw_codes(spark, sf, "vec_id"))


_LATENT = f"""WITH {X.LONG}, z AS (SELECT vec_id, o, sum(x * aw) + max(b) AS z FROM vec JOIN (
    SELECT o, i, (((o*41 + i*13) % 997) / 997e0 - 0.5e0)::FLOAT::DOUBLE AS aw, ((o % 7) / 50e0)::FLOAT::DOUBLE AS b
    FROM range(32) t(o), range(64) u(i)) ON i = f GROUP BY vec_id, o),
n AS (SELECT vec_id, sqrt(sum(z * z)) AS n FROM z GROUP BY vec_id)"""


@query("C9_ae_encode", f"{_LATENT} SELECT vec_id, o::INTEGER AS pos, round((z / greatest(n, 1e-8))::FLOAT::DOUBLE, 5) AS x FROM z JOIN n USING (vec_id)")
def c9(spark, sf):
    return _vector_rows(C.ae_encode(X.vectors(spark, sf, "vec_id"), linear_ae()), "latent")


@query("C10_ae_forward", f"""{_LATENT}
SELECT vec_id, i::INTEGER AS pos, round(sum(z * (((o*41 + i*13) % 997) / 997e0 - 0.5e0)::FLOAT::DOUBLE)::FLOAT::DOUBLE, 5) AS x
FROM z, range(64) u(i) GROUP BY vec_id, i""")
def c10(spark, sf):
    return _vector_rows(C.ae_forward(X.vectors(spark, sf, "vec_id"), linear_ae()), "x_hat")


def _mlp():
    """Two layers of closed-form weights each way."""
    import numpy as np
    layer = lambda n, m, a, b: ((((np.arange(n)[:, None] * a + np.arange(m) * b) % 991) / 991.0 - 0.5).astype(np.float32),
                                (np.arange(n) % 5 / 40.0).astype(np.float32))
    return C.DenseAE([layer(24, X.DIM, 37, 11), layer(8, 24, 53, 17)], [layer(24, 8, 29, 19), layer(X.DIM, 24, 43, 23)])


def _layer_sql(name, source, n, m, a, b):
    """name(vec_id, o, z) of a linear layer on source(vec_id, i, x)."""
    return f"""{name} AS (SELECT vec_id, o, sum(x * w) + max(bias) AS z FROM {source} JOIN (
    SELECT o, i, (((o*{a} + i*{b}) % 991) / 991e0 - 0.5e0)::FLOAT::DOUBLE AS w, ((o % 5) / 40e0)::FLOAT::DOUBLE AS bias
    FROM range({n}) t(o), range({m}) u(i)) USING (i) GROUP BY vec_id, o)"""


def _gelu_sql(name, source):
    """name(vec_id, i, x): the error function by its power series, exact to 1e-12 for the sizes that occur."""
    erf = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 50), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(z / sqrt(2), 2 * n + 1) / (gamma(n + 1e0) * (2 * n + 1))))"
    return f"{name} AS (SELECT vec_id, o AS i, 0.5 * z * (1 + {erf}) AS x FROM {source})"


_MLP = ",\n".join(["WITH " + X.LONG.strip(), "inp AS (SELECT vec_id, f AS i, x FROM vec)", _layer_sql("h1", "inp", 24, 64, 37, 11), _gelu_sql("g1", "h1"),
                   _layer_sql("lat", "g1", 8, 24, 53, 17), "n AS (SELECT vec_id, sqrt(sum(z * z)) AS n FROM lat GROUP BY vec_id)"])


@query("C9_mlp_encode", f"{_MLP} SELECT vec_id, o::INTEGER AS pos, round((z / greatest(n, 1e-8))::FLOAT::DOUBLE, 5) AS x FROM lat JOIN n USING (vec_id)")
def c9_mlp(spark, sf):
    return _vector_rows(C.ae_encode(X.vectors(spark, sf, "vec_id"), _mlp()), "latent")


@query("C10_mlp_forward", ",\n".join([_MLP, "raw AS (SELECT vec_id, o AS i, z AS x FROM lat)", _layer_sql("h2", "raw", 24, 8, 29, 19), _gelu_sql("g2", "h2"),
                                      _layer_sql("fin", "g2", 64, 24, 43, 23)]) + " SELECT vec_id, o::INTEGER AS pos, round(z::FLOAT::DOUBLE, 5) AS x FROM fin")
def c10_mlp(spark, sf):
    return _vector_rows(C.ae_forward(X.vectors(spark, sf, "vec_id"), _mlp()), "x_hat")


@query("C11_sharded_encode", f"WITH {X.sae_sql()} {_ROWS}")
def c11(spark, sf):
    weights, meta = X.coder().to_frames(spark)
    codes = C.encode_sharded(X.vectors(spark, sf, "row_idx"), weights, meta, X.SAE_K, shard_features=100)
    return _rows(codes.withColumnRenamed("row_idx", "vec_id"))


def _full_rotation(spark, sf):
    """All components: the fitted ones and the direction they leave."""
    import numpy as np
    fit = C.pca_fit(X.vectors(spark, sf, "row_idx"), X.DIM - 1)
    last = np.linalg.svd(fit.components, full_matrices=True)[0][:, -1:]
    return C.PCAModel(fit.mean, np.hstack([fit.components, last]), fit.method, fit.n_fit)


@query("C12_pca_fit", f"""WITH {X.LONG} SELECT 'total_variance' AS fact, round(sum(v), 4) AS value FROM (
SELECT var_samp(x) AS v FROM vec GROUP BY f) UNION ALL SELECT unnest(['ascending_steps', 'correlated_pairs', 'non_orthogonal']), 0e0""")
def c12(spark, sf):
    """What makes a rotation the principal one: orthonormal, uncorrelated along its axes, variances
    descending and adding up to that of the corpus."""
    import numpy as np
    model = _full_rotation(spark, sf)
    skew = np.abs(model.components.T @ model.components - np.eye(X.DIM)).max()
    z = C.pca_project(X.vectors(spark, sf, "row_idx"), model).select("row_idx", F.posexplode("latent").alias("i", "z"))
    z = z.withColumn("z", F.col("z").cast("double"))
    variances = z.groupBy("i").agg(F.var_samp("z").alias("v")).withColumnRenamed("i", "j")
    steps = variances.alias("a").join(variances.alias("b"), F.expr("b.j = a.j + 1")).agg(
        F.count_if(F.col("b.v") > F.col("a.v") + 1e-9).cast("double").alias("value"))
    pairs = z.join(z.select("row_idx", F.col("i").alias("j"), F.col("z").alias("y")), "row_idx").where("i < j").groupBy("i", "j").agg(
        F.covar_samp("z", "y").alias("c"))
    crossed = pairs.agg(F.count_if(F.abs("c") > 1e-7).cast("double").alias("value"))
    total = variances.agg(F.round(F.sum("v"), 4).alias("value"))
    square = spark.range(1).select(F.lit(float(skew > 1e-8)).alias("value"))
    facts = (("total_variance", total), ("ascending_steps", steps), ("correlated_pairs", crossed), ("non_orthogonal", square))
    out = [df.select(F.lit(name).alias("fact"), "value") for name, df in facts]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("C13_pca_project", f"""WITH {X.LONG}, m AS (SELECT f, avg(x) AS m FROM vec GROUP BY f)
SELECT vec_id, round(sum((x - m) * (x - m)), 2) AS energy FROM vec JOIN m USING (f) GROUP BY vec_id""")
def c13(spark, sf):
    """All components but an identity: a rotation of the centred vectors keeps their length."""
    return C.pca_project(X.vectors(spark, sf, "vec_id"), _full_rotation(spark, sf)).select(
        "vec_id", F.round(V.dot("latent", "latent"), 2).alias("energy"))


@query("C15_normalize_decoder", f"""WITH {X.LONG}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM vec GROUP BY vec_id)
SELECT vec_id AS feature_id, f::INTEGER AS pos, round((x / greatest(n, 1e-8))::FLOAT::DOUBLE, 6) AS x FROM vec JOIN n USING (vec_id)""")
def c15(spark, sf):
    """The stored vectors taken as dictionary rows."""
    w = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("feature_id"), F.col("embedding").alias("dec"))
    return C.normalize_decoder(w).select("feature_id", F.posexplode("dec").alias("pos", "x")).select(
        "feature_id", "pos", X.r6(F.col("x").cast("double")).alias("x"))


@query("S12_K7_weights_round_trip", f"WITH {X.sae_sql()} {_ROWS}")
def s12(spark, sf):
    path = X.scratch(spark, "weights")
    stores.write_weights(X.coder(), spark, path, label="closed form")
    return _rows(C.encode(X.vectors(spark, sf, "vec_id"), stores.read_weights(spark, path)).select("vec_id", "code"))


@query("D5_code_forms", f"WITH {X.raw_sql()} {_ROWS}")
def d5(spark, sf):
    """Packed codes unpacked, packed again and unpacked."""
    long = C.active_features(X.raw_codes(spark, sf, "vec_id"))
    return _rows(C.pack_codes(long, ["vec_id"]))


@query("D6_postings_by_feature", f"""WITH {X.sae_sql()} SELECT f::INTEGER AS feature_id, count(*)::BIGINT AS docs,
round(max(w::DOUBLE), 6) AS max_weight FROM codes GROUP BY f""")
def d6(spark, sf):
    return S.build_index(X.sae_codes(spark, sf, "doc_idx")).postings.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("docs"), X.r6(F.max("weight").cast("double")).alias("max_weight"))
