"""Index and top-k search."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import metrics as M
from ..operators import search as S
from ..operators.coding import raw_topk_encode
from ..plans import suites
from ..session import cut_lineage, spread
from ..sources import stores
from . import inputs as X
from .registry import query


def _index(spark, sf):
    return S.build_index(X.raw_codes(spark, sf, "doc_idx"))


@query("R1_build_index_postings", f"""WITH {X.raw_sql()}, n AS (
  SELECT vec_id, sqrt(sum(w::DOUBLE * w::DOUBLE)) AS n FROM codes GROUP BY vec_id)
SELECT f::INTEGER AS feature_id, vec_id AS doc_idx, round(w::DOUBLE, 6) AS weight, round(n, 6) AS doc_norm
FROM codes JOIN n USING (vec_id)""")
def r1(spark, sf):
    return _index(spark, sf).postings.select(
        "feature_id", "doc_idx", X.r6(F.col("weight").cast("double")).alias("weight"), X.r6("doc_norm").alias("doc_norm"))


@query("R1_build_index_doc_stats", f"""WITH {X.raw_sql()}
SELECT vec_id AS doc_idx, round(coalesce(sqrt(sum(w::DOUBLE * w::DOUBLE)), 0), 6) AS norm, count(w)::INTEGER AS length
FROM embeddings LEFT JOIN codes USING (vec_id) GROUP BY vec_id""")
def r1_stats(spark, sf):
    return _index(spark, sf).doc_stats.select("doc_idx", X.r6("norm").alias("norm"), "length")


@query("R2_sparse_search_dot", f"WITH {X.search_sql(X.raw_sql())} {X.RUN_ROWS}")
def r2(spark, sf):
    return X.run_rows(_index(spark, sf).search(X.raw_codes(spark, sf, "q_idx"), X.TOP))


@query("R2_sparse_search_blocks", f"WITH {X.search_sql(X.raw_sql())} {X.RUN_ROWS}")
def r2_blocks(spark, sf):
    """The same search in the form for query sides that are too large to broadcast."""
    return X.run_rows(_index(spark, sf).search(
        X.raw_codes(spark, sf, "q_idx"), X.TOP, strategy="blocks", query_bytes=1 << 20))


# The benchmark texts as queries against all documents, looked up in the postings table.
_TEXT_SQL = """
texts AS (SELECT 'q' AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 'd', doc_id, text FROM documents),
tokens AS (SELECT side, id, md5(t) AS h FROM (
    SELECT side, id, unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) AS t FROM texts) WHERE t <> ''),
hashed AS (SELECT side, id, (('0x' || substr(h, 1, 8))::BIGINT % 64)::INTEGER AS f,
    sum(CASE WHEN ('0x' || substr(h, 9, 1))::INTEGER % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS c FROM tokens GROUP BY ALL),
lens AS (SELECT side, id, sqrt(sum(c * c)) AS n FROM hashed GROUP BY side, id),
emb AS (SELECT side, id, f, (c / (n + 1e-8))::FLOAT AS w FROM hashed JOIN lens USING (side, id))""".replace(
    "\t", "\\t").replace("\r", "\\r").replace("\f", "\\f").replace("\v", "\\v").replace("[ \\t\n", "[ \\t\\n")


def text_vectors(spark, sf, name, id_col, key):
    from ..operators.embed import HashingEmbedder, embed
    t = X.table(spark, sf, name).select(F.col(id_col).alias(key), "text")
    return embed(spread(t), lambda: HashingEmbedder(64), keep=[key])


_TEXT_RAW = f"""{_TEXT_SQL},
tcode AS (SELECT side, id, f, w FROM (SELECT *, row_number() OVER (PARTITION BY side, id ORDER BY abs(w) DESC, f) AS r
          FROM emb) WHERE r <= 16 AND w <> 0)"""


@query("R2_bounded_lookup", f"WITH {X.search_sql(X.raw_sql(), top=10)} {X.RUN_ROWS}")
def r2_bounded(spark, sf):
    """Signed codes looked up through the stored bounds of blocks of documents."""
    path = X.scratch(spark, "bounded")
    stores.write_index(_index(spark, sf), path)
    return X.run_rows(stores.read_index(spark, path).search(X.raw_codes(spark, sf, "q_idx"), 10, backend="bounded"))


@query("R3_bounded_lookup_cosine", f"WITH {X.search_sql(X.raw_sql(), 'cosine', 'positive', top=10)} {X.RUN_ROWS}")
def r3_bounded(spark, sf):
    return X.run_rows(_index(spark, sf).search(X.raw_codes(spark, sf, "q_idx"), 10, "cosine", "bounded", positive_only=True))


@query("R2_text_lookup", f"""WITH {_TEXT_RAW}, s AS (
  SELECT q.id AS q_idx, d.id AS doc_idx, sum(q.w::DOUBLE * d.w::DOUBLE) AS s FROM tcode q JOIN tcode d
  ON d.f = q.f AND q.side = 'q' AND d.side = 'd' GROUP BY q.id, d.id)
SELECT q_idx, doc_idx, rank::INTEGER AS rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (
  PARTITION BY q_idx ORDER BY round(s, 9) DESC, doc_idx) AS rank FROM s) WHERE rank <= 100""")
def r2_lookup(spark, sf):
    def codes(name, id_col, key):
        return raw_topk_encode(text_vectors(spark, sf, name, id_col, key), 16).select(key, "code")
    index = S.build_index(codes("documents", "doc_id", "doc_idx"))
    return X.run_rows(index.search(codes("benchmark", "item_id", "q_idx"), X.TOP, backend="postings"))


@query("R3_sparse_search_cosine", f"WITH {X.search_sql(X.raw_sql(), 'cosine')} {X.RUN_ROWS}")
def r3(spark, sf):
    return X.run_rows(_index(spark, sf).search(X.raw_codes(spark, sf, "q_idx"), X.TOP, "cosine"))


@query("R4_positive_search_cosine", f"WITH {X.search_sql(X.raw_sql(), 'cosine', 'positive', 'clamp')} {X.RUN_ROWS}")
def r4(spark, sf):
    return X.run_rows(_index(spark, sf).search(
        X.raw_codes(spark, sf, "q_idx"), X.TOP, "cosine", epsilon="clamp", positive_only=True))


@query("R4_coder_search_dot", f"WITH {X.search_sql(X.sae_sql(), candidates='positive')} {X.RUN_ROWS}")
def r4_coder(spark, sf):
    return X.run_rows(S.sparse_search(X.sae_codes(spark, sf, "q_idx"), X.sae_codes(spark, sf, "doc_idx"),
                                      X.TOP, candidates="positive"))


@query("R5_all_documents_search", f"WITH {X.search_sql(X.raw_sql(4), candidates='all')} {X.RUN_ROWS}")
def r5(spark, sf):
    return X.run_rows(S.sparse_search(X.raw_codes(spark, sf, "q_idx", 4), X.raw_codes(spark, sf, "doc_idx", 4),
                                      X.TOP, candidates="all"))


@query("R6_dense_search", f"WITH {X.dense_sql()} {X.RUN_ROWS}")
def r6(spark, sf):
    return X.run_rows(S.dense_search(X.vectors(spark, sf, "q_idx"), X.vectors(spark, sf, "doc_idx"), X.TOP))


@query("R6_dense_search_blocks", f"WITH {X.dense_sql()} {X.RUN_ROWS}")
def r6_blocks(spark, sf):
    return X.run_rows(S.dense_search(X.vectors(spark, sf, "q_idx"), X.vectors(spark, sf, "doc_idx"), X.TOP,
                                     strategy="blocks", query_bytes=1 << 20))


@query("R6_text_dense_search", f"""WITH {_TEXT_SQL}, s AS (
  SELECT q.item_id AS q_idx, d.doc_id AS doc_idx, coalesce(max(x.s), 0) AS s FROM benchmark q CROSS JOIN documents d
  LEFT JOIN (SELECT q.id AS qi, d.id AS di, sum(q.w::DOUBLE * d.w::DOUBLE) AS s FROM emb q JOIN emb d
    ON d.f = q.f AND q.side = 'q' AND d.side = 'd' GROUP BY q.id, d.id) x ON x.qi = q.item_id AND x.di = d.doc_id
  GROUP BY q.item_id, d.doc_id)
SELECT q_idx, doc_idx, rank::INTEGER AS rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (
  PARTITION BY q_idx ORDER BY round(s, 9) DESC, doc_idx) AS rank FROM s) WHERE rank <= 100""")
def r6_text(spark, sf):
    return X.run_rows(S.dense_search(text_vectors(spark, sf, "benchmark", "item_id", "q_idx"),
                                     text_vectors(spark, sf, "documents", "doc_id", "doc_idx"), X.TOP))


@query("R7_dense_top100_judged", f"WITH {X.dense_sql()}, {X.RELEVANCE} {X.RUN_ROWS} WHERE q_idx IN (SELECT q_idx FROM rel)")
def r7(spark, sf):
    q = suites.judged(X.vectors(spark, sf, "q_idx"), X.relevance(spark, sf))
    return X.run_rows(S.dense_search(q, X.vectors(spark, sf, "doc_idx"), 100))


@query("R8_index_stats", f"""WITH {X.raw_sql()}, p AS (SELECT f, count(*) AS n FROM codes GROUP BY f)
SELECT (SELECT count(*) FROM embeddings)::BIGINT AS num_docs, count(*)::BIGINT AS features_used,
  format('{{:.1f}}', avg(n)) AS avg_posting_length,
  format('{{:.1f}}', (SELECT count(*) FROM codes) / (SELECT count(*) FROM embeddings)) AS avg_doc_length FROM p""")
def r8(spark, sf):
    return S.index_stats(_index(spark, sf))


@query("R9_code_stats", f"""WITH {X.sae_sql()}, n AS (SELECT e.vec_id, count(c.f) AS n
  FROM embeddings e LEFT JOIN codes c ON c.vec_id = e.vec_id GROUP BY e.vec_id)
SELECT avg(n) AS mean_active, round(stddev_pop(n), 6) AS std_active, round(1 - avg(n) / {X.DICT}, 6) AS sparsity,
  round((SELECT count(DISTINCT f) FROM codes) / {X.DICT}e0, 6) AS dictionary_use FROM n""")
def r9(spark, sf):
    return S.code_stats(X.sae_codes(spark, sf, "doc_idx"), X.DICT).select(
        "mean_active", *[X.r6(c).alias(c) for c in ("std_active", "sparsity", "dictionary_use")])


@query("K6_S14_index_round_trip", f"WITH {X.search_sql(X.raw_sql())} {X.RUN_ROWS}")
def k6(spark, sf):
    path = X.scratch(spark, "index")
    stores.write_index(_index(spark, sf), path)
    return X.run_rows(stores.read_index(spark, path).search(X.raw_codes(spark, sf, "q_idx"), X.TOP))


@query("U3_backends_agree", "SELECT 0::BIGINT AS differences")
def u3(spark, sf):
    """Rows on which the postings and the scan backend disagree over the text corpus."""
    def codes(name, id_col, key):
        return raw_topk_encode(text_vectors(spark, sf, name, id_col, key), 16).select(key, "code")
    index, q = S.build_index(codes("documents", "doc_id", "doc_idx")), codes("benchmark", "item_id", "q_idx")
    a = X.run_rows(index.search(q, X.TOP, "cosine", "postings"))
    b = X.run_rows(index.search(q, X.TOP, "cosine", "scan"))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("differences"))


# ---------------------------------------------------------------- aggregate, window and sort forms

@query("A1_sum_by_pair", f"""WITH {X.raw_sql()} SELECT a.l_orderkey AS q_idx, a.l_partkey AS doc_idx,
round(sum(x.w::DOUBLE * y.w::DOUBLE), 6) AS score FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a
JOIN codes x ON x.vec_id = a.l_orderkey JOIN codes y ON y.vec_id = a.l_partkey AND y.f = x.f GROUP BY ALL""")
def a1(spark, sf):
    """Scores of the judged (order, part) pairs only: a join on the feature, summed per pair."""
    pairs = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("q_idx"), F.col("l_partkey").alias("doc_idx")).distinct()
    q = X.raw_codes(spark, sf, "q_idx").select("q_idx", F.explode("code").alias("q"))
    d = S.postings_of(X.raw_codes(spark, sf, "doc_idx")).select("doc_idx", "feature_id", "weight")
    q = q.select("q_idx", F.col("q.feature_id").alias("feature_id"), F.col("q.weight").alias("q_weight"))
    return pairs.join(q, "q_idx").join(d, ["doc_idx", "feature_id"]).groupBy("q_idx", "doc_idx").agg(
        X.r6(F.sum(F.col("q_weight").cast("double") * F.col("weight").cast("double"))).alias("score"))


@query("A2_posting_lengths", f"WITH {X.raw_sql()} SELECT f::INTEGER AS feature_id, count(*)::BIGINT AS n FROM codes GROUP BY f")
def a2(spark, sf):
    return _index(spark, sf).postings.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))


@query("A3_weight_moments", f"""WITH {X.raw_sql()} SELECT f::INTEGER AS feature_id, round(avg(w::DOUBLE), 6) AS mean,
round(stddev_pop(w::DOUBLE), 6) AS std, round(sqrt(sum(w::DOUBLE * w::DOUBLE)), 6) AS norm FROM codes GROUP BY f""")
def a3(spark, sf):
    w = F.col("weight").cast("double")
    return _index(spark, sf).postings.groupBy("feature_id").agg(
        X.r6(F.avg(w)).alias("mean"), X.r6(F.stddev_pop(w)).alias("std"), X.r6(F.sqrt(F.sum(w * w))).alias("norm"))


@query("A4_vector_mean", f"WITH {X.LONG} SELECT f::INTEGER AS pos, round(avg(x), 6) AS mean FROM vec GROUP BY f")
def a4(spark, sf):
    from ..operators.embed import vector_mean
    return vector_mean(X.table(spark, sf, "embeddings")).select("pos", X.r6("mean").alias("mean"))


@query("A5_any_active", f"""WITH {X.sae_sql()} SELECT f.f::INTEGER AS feature_id,
f.f IN (SELECT f FROM codes) AS active FROM range({X.DICT}) f(f)""")
def a5(spark, sf):
    used = X.sae_codes(spark, sf, "doc_idx").select(F.explode(V.features("code")).alias("feature_id")).groupBy(
        "feature_id").agg(F.bool_or(F.lit(True)).alias("active"))
    every = spark.range(X.DICT).select(F.col("id").cast("int").alias("feature_id"))
    return every.join(used, "feature_id", "left").select(
        "feature_id", F.coalesce("active", F.lit(False)).alias("active"))


@query("A6_argmax_tie_rule", f"""WITH {X.raw_sql()} SELECT f::INTEGER AS feature_id, vec_id AS doc_idx FROM (
SELECT *, row_number() OVER (PARTITION BY f ORDER BY round(w::DOUBLE, 3) DESC, vec_id) AS n FROM codes) WHERE n = 1""")
def a6(spark, sf):
    return _index(spark, sf).postings.groupBy("feature_id").agg(F.max_by(
        "doc_idx", F.struct(F.round(F.col("weight").cast("double"), 3), -F.col("doc_idx"))).alias("doc_idx"))


@query("A7_first_last_by_order", """SELECT label, min_by(vec_id, vec_id) AS first_id, max_by(vec_id, vec_id) AS last_id
FROM embeddings GROUP BY label""")
def a7(spark, sf):
    return X.table(spark, sf, "embeddings").groupBy("label").agg(
        F.min_by("vec_id", "vec_id").alias("first_id"), F.max_by("vec_id", "vec_id").alias("last_id"))


@query("A8_distinct_pairs", "SELECT DISTINCT l_orderkey AS q_idx, l_partkey AS doc_idx FROM lineitem")
def a8(spark, sf):
    return X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("q_idx"), F.col("l_partkey").alias("doc_idx")).distinct()


@query("A9_ordered_list", """SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts
FROM lineitem GROUP BY l_orderkey""")
def a9(spark, sf):
    """Lists of one order's lines: an order has a handful of lines, so the groups are bounded."""
    entry = F.struct("l_linenumber", "l_partkey")
    return X.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(entry)).alias("e")).select("l_orderkey", F.array_join(
            F.transform("e", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("W1_rank_and_cut", f"WITH {X.search_sql(X.raw_sql(), top=10)} {X.RUN_ROWS}")
def w1(spark, sf):
    return X.run_rows(X.raw_run(spark, sf, 10))


@query("W2_first_relevant", f"""WITH {X.search_sql(X.raw_sql())}, {X.RELEVANCE}
SELECT q_idx, min(rank)::INTEGER AS first_rank FROM run JOIN rel USING (q_idx, doc_idx) GROUP BY q_idx""")
def w2(spark, sf):
    return M.relevant_hits(X.raw_run(spark, sf), cut_lineage(X.relevance(spark, sf))).groupBy("q_idx").agg(
        F.min("rank").alias("first_rank"))


@query("W3_enumerate", """SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey
ORDER BY l_extendedprice DESC, l_linenumber, l_partkey)::INTEGER AS rank FROM lineitem""")
def w3(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_linenumber", "l_partkey")
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.row_number().over(w).alias("rank"))


@query("O1_sorted_head", """SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100""")
def o1(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(
        F.col("n_chars").desc(), "doc_id").limit(100)


@query("O2_sort_inside_row", f"WITH {X.raw_sql(8)} SELECT vec_id, f::INTEGER AS feature_id, r::INTEGER AS code_rank FROM codes")
def o2(spark, sf):
    from ..operators.coding import active_features
    return active_features(X.raw_codes(spark, sf, "vec_id", 8)).select("vec_id", "feature_id", "code_rank")


@query("O3_merge_top_lists", f"WITH {X.search_sql(X.raw_sql(), top=20)} {X.RUN_ROWS}")
def o3(spark, sf):
    """Top lists of two halves of the corpus merged: the same as the top list of the whole."""
    q, d = X.raw_codes(spark, sf, "q_idx"), X.raw_codes(spark, sf, "doc_idx")
    half = F.xxhash64("doc_idx") % 2 == 0
    lists = S.sparse_search(q, d.where(half), 20).unionByName(S.sparse_search(q, d.where(~half), 20))
    w = Window.partitionBy("q_idx").orderBy(F.round("score", 9).desc(), "doc_idx")
    return X.run_rows(lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 20))


@query("J11_scoring_product", f"WITH {X.dense_sql(1)} {X.RUN_ROWS}")
def j11(spark, sf):
    """Best match of every vector by the full scoring product; pairs are never materialised."""
    return X.run_rows(S.dense_search(X.vectors(spark, sf, "q_idx"), X.vectors(spark, sf, "doc_idx"), 1))


@query("J12_feature_join", f"""WITH {X.raw_sql()} SELECT a.vec_id, count(*)::BIGINT AS shared FROM codes a
JOIN codes b ON b.vec_id = a.vec_id + 1 AND b.f = a.f GROUP BY a.vec_id""")
def j12(spark, sf):
    p = S.postings_of(X.raw_codes(spark, sf, "doc_idx")).select("feature_id", "doc_idx")
    b = p.select("feature_id", (F.col("doc_idx") - 1).alias("doc_idx"))
    return p.join(b, ["doc_idx", "feature_id"]).groupBy(F.col("doc_idx").alias("vec_id")).agg(
        F.count(F.lit(1)).alias("shared"))
