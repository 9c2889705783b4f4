"""Relevance, positives, negatives, samples and splits."""

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import relevance as R
from ..session import cut_lineage
from . import inputs as X
from .registry import query

# Annotations of an order: its first two lines' parts are positive, the supplier ids of all lines negative.
_ANNOTATED = """
qd AS (SELECT DISTINCT l_orderkey AS q_idx FROM lineitem WHERE l_orderkey IN (SELECT vec_id FROM embeddings)),
apos AS (SELECT l_orderkey AS q_idx, l_partkey AS doc_idx FROM lineitem WHERE l_linenumber <= 2),
aneg AS (SELECT l_orderkey AS q_idx, l_suppkey AS doc_idx FROM lineitem UNION ALL
         SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 2),
jud AS (SELECT l_orderkey AS q_idx, l_partkey AS doc_idx FROM lineitem WHERE l_linenumber > 2),
pos AS (SELECT DISTINCT q_idx, doc_idx FROM (SELECT * FROM apos UNION ALL SELECT * FROM jud)
        WHERE q_idx IN (SELECT vec_id FROM embeddings) AND doc_idx IN (SELECT vec_id FROM embeddings)),
neg AS (SELECT DISTINCT q_idx, doc_idx FROM aneg WHERE doc_idx IN (SELECT vec_id FROM embeddings)
        AND q_idx IN (SELECT q_idx FROM pos) AND (q_idx, doc_idx) NOT IN (SELECT (q_idx, doc_idx) FROM pos))"""


def _annotations(spark, sf):
    """One record per order; an order has a handful of lines."""
    li = X.table(spark, sf, "lineitem")
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    return li.groupBy(F.col("l_orderkey").cast("string").alias("qid")).agg(
        F.collect_list(F.when(F.col("l_linenumber") <= 2, part)).alias("pos_ids"),
        F.concat(F.collect_list(supplier), F.collect_list(F.when(F.col("l_linenumber") == 2, part))).alias("neg_ids"))


def _pos(spark, sf):
    items = X.item_rows(spark, sf)
    return R.positives(items, items, _annotations(spark, sf), X.judgments(spark, sf))


def _neg(spark, sf, pos=None):
    items = X.item_rows(spark, sf)
    return R.explicit_negatives(items, items, _annotations(spark, sf), _pos(spark, sf) if pos is None else pos)


@query("J1_relevance", f"WITH {X.RELEVANCE} SELECT q_idx, doc_idx FROM rel")
def j1(spark, sf):
    return X.relevance(spark, sf)


@query("J1_judged_queries", f"WITH {X.RELEVANCE} SELECT vec_id AS q_idx FROM embeddings WHERE vec_id IN (SELECT q_idx FROM rel)")
def j1_judged(spark, sf):
    return R.judged_queries(X.item_rows(spark, sf), X.relevance(spark, sf)).select(F.col("row_idx").alias("q_idx"))


@query("J1_duplicate_ids", "SELECT label::VARCHAR AS id, max(vec_id) AS row_idx FROM embeddings GROUP BY label")
def j1_duplicates(spark, sf):
    items = X.table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("item_id"), F.col("vec_id").alias("row_idx"))
    return R.pool_ids(items)


@query("J2_positives", f"WITH {_ANNOTATED} SELECT q_idx, doc_idx FROM pos")
def j2(spark, sf):
    return _pos(spark, sf)


@query("J3_explicit_negatives", f"WITH {_ANNOTATED} SELECT q_idx, doc_idx FROM neg")
def j3(spark, sf):
    return _neg(spark, sf)


def _negatives_sql(n, seed=7):
    return f"""WITH {_ANNOTATED}, nd AS (SELECT count(*) AS n FROM embeddings),
want AS (SELECT q_idx, least({n}, greatest(0, (SELECT n FROM nd) - count(*))) AS target FROM pos GROUP BY q_idx),
listed AS (SELECT q_idx, doc_idx, pick FROM (SELECT neg.q_idx, doc_idx, target, row_number() OVER (PARTITION BY neg.q_idx
    ORDER BY md5('{seed}:' || neg.q_idx || ':' || doc_idx)) AS pick FROM neg JOIN want USING (q_idx)) WHERE pick <= target),
need AS (SELECT w.q_idx, target - count(l.doc_idx) AS need, count(l.doc_idx) AS n_listed FROM want w
    LEFT JOIN listed l USING (q_idx) GROUP BY w.q_idx, target HAVING target > count(l.doc_idx)),
used AS (SELECT q_idx, doc_idx FROM pos UNION ALL SELECT q_idx, doc_idx FROM listed),
draws AS (SELECT q_idx, need, n_listed, unnest(range(8 * greatest(32, 4 * need))) AS draw FROM need),
hit AS (SELECT q_idx, need, n_listed, draw,
    ('0x' || substr(md5('{seed}:draw:' || q_idx || ':' || draw), 1, 15))::BIGINT % (SELECT n FROM nd) AS doc_idx FROM draws),
fresh AS (SELECT q_idx, doc_idx, min(draw) AS draw, max(need) AS need, max(n_listed) AS n_listed FROM hit GROUP BY q_idx, doc_idx
    HAVING (q_idx, doc_idx) NOT IN (SELECT (q_idx, doc_idx) FROM used)),
filled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY draw) AS r FROM fresh) WHERE r <= need),
short AS (SELECT q_idx, need, n_listed FROM need WHERE need > (SELECT count(*) FROM filled f WHERE f.q_idx = need.q_idx)),
rest AS (SELECT * FROM (SELECT q_idx, vec_id AS doc_idx, need, n_listed, row_number() OVER (PARTITION BY q_idx
    ORDER BY md5('{seed}:pool:' || q_idx || ':' || vec_id)) AS r FROM short CROSS JOIN embeddings
    WHERE (q_idx, vec_id) NOT IN (SELECT (q_idx, doc_idx) FROM used)) WHERE r <= need)
SELECT q_idx, doc_idx, pick::INTEGER AS pick FROM listed
UNION ALL SELECT q_idx, doc_idx, (r + n_listed)::INTEGER FROM filled WHERE q_idx NOT IN (SELECT q_idx FROM short)
UNION ALL SELECT q_idx, doc_idx, (r + n_listed)::INTEGER FROM rest"""


def _negatives(n):
    def run(spark, sf):
        n_docs = X.table(spark, sf, "embeddings").count()
        pos = cut_lineage(_pos(spark, sf))
        return R.sample_negatives(pos, _neg(spark, sf, pos), n_docs, n, 7)
    return run


query("J4_negatives", _negatives_sql(15))(_negatives(15))
query("J4_negatives_near_pool_size", _negatives_sql(490))(_negatives(490))


@query("J5_triplets", """WITH nd AS (SELECT count(*) AS n FROM embeddings),
hit AS (SELECT vec_id, draw, ('0x' || substr(md5('11:draw:' || vec_id || ':' || draw), 1, 15))::BIGINT % (SELECT n FROM nd) AS doc_idx
  FROM embeddings, range(32) t(draw)),
fresh AS (SELECT vec_id, doc_idx, min(draw) AS draw FROM hit GROUP BY vec_id, doc_idx),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY draw) AS r FROM fresh) WHERE r <= 7)
SELECT vec_id AS row_idx, r::INTEGER AS draw, doc_idx AS neg_idx, CASE WHEN vec_id % 2 = 0 THEN 'text' ELSE 'image' END AS query_side,
  CASE WHEN vec_id % 2 = 0 THEN 'image' ELSE 'text' END AS negative_side FROM picked WHERE doc_idx <> vec_id""")
def j5(spark, sf):
    e = X.item_rows(spark, sf)
    return R.sample_triplets(e, e.count(), 7, 11)


@query("J6_alignment_pairs", f"WITH {_ANNOTATED} SELECT q_idx, min(doc_idx) AS doc_idx FROM pos GROUP BY q_idx")
def j6(spark, sf):
    return R.alignment_pairs(_pos(spark, sf))


@query("J7_choose_positive", f"""WITH {_ANNOTATED} SELECT q_idx, arg_min(doc_idx, md5('5:0:' || q_idx || ':' || doc_idx)) AS doc_idx
FROM pos GROUP BY q_idx""")
def j7(spark, sf):
    return R.choose_positive(_pos(spark, sf), 5)


def _split(split):
    size = "(SELECT least(greatest(round_even(count(*) * 0.15, 0)::INT, 1), count(*) - 1) FROM q)"
    test = "<=" if split == "val" else ">"

    @query(f"J8_retrieval_split_{split}", f"""WITH {_ANNOTATED}, q AS (SELECT DISTINCT q_idx FROM pos),
r AS (SELECT q_idx, row_number() OVER (ORDER BY md5('3:' || q_idx) DESC) AS n FROM q)
SELECT q_idx FROM r WHERE n {test} {size}""")
    def run(spark, sf):
        q = _pos(spark, sf).select("q_idx").distinct()
        return R.retrieval_split(q, q.count(), 0.15, 3, split)


_split("train")
_split("val")


@query("J9_seeded_sample", """SELECT row_idx FROM (SELECT vec_id AS row_idx, row_number() OVER (ORDER BY md5('42:' || vec_id) DESC) AS n
FROM embeddings) WHERE n <= (SELECT count(*) // 3 FROM embeddings)""")
def j9(spark, sf):
    e = X.item_rows(spark, sf)
    n = e.count()
    return R.seeded_sample(e, n, n // 3, 42).select("row_idx")


@query("J10_paired_split", """SELECT vec_id AS row_idx, CASE WHEN vec_id >= (SELECT count(*) - floor(count(*) * 0.1) FROM embeddings)
THEN 'val' ELSE 'train' END AS split FROM embeddings""")
def j10(spark, sf):
    e = X.item_rows(spark, sf)
    n = e.count()
    parts = [R.paired_split(e, n, 0.1, s).select("row_idx", F.lit(s).alias("split")) for s in ("train", "val")]
    return parts[0].unionByName(parts[1])


@query("J13_positional_pairs", "SELECT vec_id AS q_idx, vec_id AS doc_idx FROM embeddings")
def j13(spark, sf):
    return R.positional_relevance(X.item_rows(spark, sf))


@query("J14_hits", f"WITH {X.search_sql(X.raw_sql())}, {X.RELEVANCE} SELECT q_idx, doc_idx, rank::INTEGER AS rank FROM run JOIN rel USING (q_idx, doc_idx)")
def j14(spark, sf):
    return M.relevant_hits(X.raw_run(spark, sf), cut_lineage(X.relevance(spark, sf))).select("q_idx", "doc_idx", "rank")


@query("J15_available_documents", f"WITH {_ANNOTATED} SELECT vec_id AS doc_idx FROM embeddings WHERE vec_id NOT IN (SELECT doc_idx FROM pos)")
def j15(spark, sf):
    docs = X.item_rows(spark, sf).select(F.col("row_idx").alias("doc_idx"))
    return docs.join(_pos(spark, sf), "doc_idx", "left_anti")


@query("D15_training_rows", f"""WITH base AS ({_negatives_sql(4)}), {_ANNOTATED.strip()}, one AS (
  SELECT q_idx, arg_min(doc_idx, md5('5:0:' || q_idx || ':' || doc_idx)) AS pos_idx FROM pos GROUP BY q_idx)
SELECT one.q_idx, pos_idx, string_agg(base.doc_idx::VARCHAR, ',' ORDER BY pick) AS neg_idx
FROM one JOIN base ON base.q_idx = one.q_idx GROUP BY one.q_idx, pos_idx""")
def d15(spark, sf):
    """Query, chosen positive and four sampled negatives."""
    pos = cut_lineage(_pos(spark, sf))
    negatives = R.sample_negatives(pos, _neg(spark, sf, pos), X.table(spark, sf, "embeddings").count(), 4, 7)
    return R.training_rows(pos, negatives, 5).select("q_idx", "pos_idx", F.array_join(
        F.transform("neg_idx", lambda x: x.cast("string")), ",").alias("neg_idx"))
