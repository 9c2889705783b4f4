"""Column functions."""

from pyspark.sql import functions as F

from ..functions import items as I
from ..functions import vector as V
from ..operators import coding as C
from ..operators import search as S
from . import inputs as X
from .registry import query

PREFIX = "Retrieve."


def _modes(spark, sf):
    return X.candidates(spark, sf).withColumn("modes", I.item_modality("modality", "txt", "img_path"))


@query("P1_item_modality", f"WITH {X.CANDIDATES} SELECT did, array_to_string(modes, ',') AS modes FROM modal")
def p1(spark, sf):
    return _modes(spark, sf).select("did", F.array_join("modes", ",").alias("modes"))


@query("P2_item_id", """SELECT doc_id::VARCHAR AS item_id, 'candidate' AS kind FROM documents
UNION ALL SELECT item_id::VARCHAR, 'query' FROM benchmark""")
def p2(spark, sf):
    d = X.table(spark, sf, "documents").select(F.col("doc_id").alias("did"))
    q = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    return d.select(I.item_id("candidate").alias("item_id"), F.lit("candidate").alias("kind")).unionByName(
        q.select(I.item_id("query").alias("item_id"), F.lit("query").alias("kind")))


@query("P3_prompt_text", f"""WITH {X.CANDIDATES}
SELECT did, md5(CASE WHEN body <> '' THEN '{PREFIX}' || chr(10) || body ELSE '' END) AS prompt_md5,
       length(body)::INTEGER AS body_chars FROM prompts""")
def p3(spark, sf):
    return _modes(spark, sf).select(
        "did", F.md5(I.prompt_text("txt", "modes", PREFIX).cast("binary")).alias("prompt_md5"),
        F.length(I.prompt_text("txt", "modes", "")).alias("body_chars"))


@query("P4_resolve_path", f"WITH {X.CANDIDATES} SELECT did, image_path FROM prompts")
def p4(spark, sf):
    return _modes(spark, sf).select("did", I.resolve_path("img_path", "modes", "/data").alias("image_path"))


_DATASET = """CASE source WHEN 'src0' THEN 'CIRR_task7' WHEN 'src1' THEN 'fashioniq_task7'
WHEN 'src2' THEN 'Fashion200k' ELSE source || '_task1' END"""


@query("P5_default_prefix", f"""SELECT doc_id, CASE split_part(lower({_DATASET}), '_task', 1)
  WHEN 'fashioniq' THEN 'Find a fashion image that aligns with the reference image and style note.'
  WHEN 'fashion200k' THEN 'Find a fashion image that aligns with the reference image and style note.'
  WHEN 'cirr' THEN 'Retrieve a day-to-day image that aligns with the modification instructions of the provided image.'
  ELSE 'Retrieve the target image that best matches the reference image and the textual modification.'
  END AS prefix FROM documents""")
def p5(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", I.default_prefix(F.expr(_DATASET)).alias("prefix"))


_CAPTION_COLUMNS = {
    "caption": "CASE WHEN role = 'user' THEN text WHEN role = 'system' THEN '' END",
    "body": "CASE WHEN role = 'assistant' AND turn < 4 THEN text END",
    "raw": "CASE WHEN turn = 5 THEN '  ' || text ELSE '' END",
}


@query("P6_caption", f"""SELECT conv_id, turn, md5(trim(coalesce(
  nullif({_CAPTION_COLUMNS['caption']}, ''), nullif({_CAPTION_COLUMNS['body']}, ''),
  nullif({_CAPTION_COLUMNS['raw']}, ''), CASE WHEN turn > 5 THEN text END, ''),
  ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS caption_md5 FROM conversations""")
def p6(spark, sf):
    t = X.table(spark, sf, "conversations").select(
        "conv_id", "turn", *[F.expr(e).alias(n) for n, e in _CAPTION_COLUMNS.items()],
        F.expr("CASE WHEN turn > 5 THEN array(text, role) ELSE array() END").alias("listed"))
    return t.select("conv_id", "turn", F.md5(
        I.caption("caption", "body", "raw", "listed").cast("binary")).alias("caption_md5"))


_FILENAME = """CASE WHEN page_id % 7 = 0 THEN NULL ELSE
concat('COCO_', CASE WHEN page_id % 2 = 0 THEN 'val2014' ELSE 'train2014' END, '_', page_id, '.jpg') END"""
_URL = ("'http://images.cocodataset.org/' || CASE WHEN fn LIKE '%val2014%' THEN 'val2014' "
        "ELSE 'train2014' END || '/' || fn")


@query("P7_image_url", f"SELECT page_id, {_URL} AS image_url FROM (SELECT page_id, {_FILENAME} AS fn FROM pages)")
def p7(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", I.image_url(F.expr(_FILENAME)).alias("image_url"))


_PATH = """CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('/img/', page_id)
WHEN 2 THEN concat('/cwd/zip:/', page_id) END"""


@query("P8_image_ref", f"""SELECT page_id, CASE WHEN regexp_matches(p, '^(http|https|oss|file)://') THEN p
  WHEN p LIKE '/img/%' AND ok THEN 'file://' || p
  ELSE coalesce({_URL}, 'file:///image.jpg') END AS image_ref
FROM (SELECT page_id, {_FILENAME} AS fn, {_PATH} AS p, page_id % 3 = 0 AS ok FROM pages)""")
def p8(spark, sf):
    return X.table(spark, sf, "pages").select(
        "page_id", I.image_ref(F.expr(_PATH), F.expr(_FILENAME), F.expr("page_id % 3 = 0")).alias("image_ref"))


@query("P9_embed_request", f"""WITH {X.CANDIDATES}, parts AS (
  SELECT did, CASE WHEN image_path IS NULL AND body = '' THEN [['text', '']] ELSE list_filter(
    [CASE WHEN image_path IS NOT NULL THEN ['image', image_path] END,
     CASE WHEN body <> '' THEN ['text', body] END], lambda x: x IS NOT NULL) END AS parts FROM prompts)
SELECT did, 'Embed.' AS system, (p.pos - 1)::INTEGER AS pos, p.part[1] AS type, md5(p.part[2]) AS value_md5
FROM (SELECT did, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM parts) p""")
def p9(spark, sf):
    prompts = _modes(spark, sf).select("did", I.embed_request(
        "Embed.", I.prompt_text("txt", "modes", ""), I.resolve_path("img_path", "modes", "/data")).alias("request"))
    return prompts.select("did", F.col("request.system").alias("system"),
                          F.posexplode("request.content").alias("pos", "part")).select(
        "did", "system", "pos", F.col("part.type").alias("type"),
        F.md5(F.col("part.value").cast("binary")).alias("value_md5"))


def _normalised(mode):
    def run(spark, sf):
        e = X.table(spark, sf, "embeddings").select("vec_id", F.transform(
            "embedding", lambda x: x.cast("double") * F.col("label")).alias("v"))
        return e.select("vec_id", F.posexplode(V.l2_normalize("v", mode)).alias("pos", "x")).select(
            "vec_id", "pos", X.r6(F.col("x").cast("double")).alias("x"))
    return run


def _normalised_sql(denominator):
    return f"""WITH {X.LONG}, scaled AS (SELECT vec_id, f, x * label AS y FROM vec JOIN embeddings USING (vec_id)),
n AS (SELECT vec_id, sqrt(sum(y * y)) AS n FROM scaled GROUP BY vec_id)
SELECT vec_id, f::INTEGER AS pos, round((y / {denominator})::FLOAT::DOUBLE, 6) AS x FROM scaled JOIN n USING (vec_id)"""


query("P10_l2_normalize_add", _normalised_sql("(n + 1e-8)"))(_normalised("add"))
query("P10_l2_normalize_clamp", _normalised_sql("greatest(n, 1e-8)"))(_normalised("clamp"))


def _pairwise(name, expression, sql):
    @query(name, f"WITH {X.NEIGHBOURS} SELECT vec_id, round({sql}, 6) AS value FROM pairs")
    def run(spark, sf):
        return X.neighbours(spark, sf).select("vec_id", X.r6(expression("a", "b")).alias("value"))


_pairwise("P11_dot", V.dot, "list_dot_product(a, b)")
_pairwise("P12_cosine", V.cosine, """list_dot_product(a, b) / (greatest(sqrt(list_dot_product(a, a)), 1e-8)
          * greatest(sqrt(list_dot_product(b, b)), 1e-8))""")
_pairwise("P13_l2_distance", V.l2_distance, "list_distance(a, b)")


def _code_pairs(spark, sf):
    c = X.raw_codes(spark, sf, "vec_id")
    b = c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("code").alias("b"))
    return c.select("vec_id", F.col("code").alias("a")).join(b, "vec_id")


_SHARED = """shared AS (SELECT x.vec_id, count(*) AS n, sum(x.w::DOUBLE * y.w::DOUBLE) AS s
  FROM codes x JOIN codes y ON y.vec_id = x.vec_id + 1 AND y.f = x.f GROUP BY x.vec_id),
size AS (SELECT vec_id, count(*) AS n, sqrt(sum(w::DOUBLE * w::DOUBLE)) AS norm FROM codes GROUP BY vec_id),
both_ AS (SELECT x.vec_id, x.n AS na, y.n AS nb, x.norm AS qa, y.norm AS qb, coalesce(s.n, 0) AS ns, coalesce(s.s, 0) AS s
  FROM size x JOIN size y ON y.vec_id = x.vec_id + 1 LEFT JOIN shared s ON s.vec_id = x.vec_id)"""


@query("P14_jaccard", f"WITH {X.raw_sql()}, {_SHARED} SELECT vec_id, round(ns / (na + nb - ns + 1e-8), 6) AS value FROM both_")
def p14(spark, sf):
    return _code_pairs(spark, sf).select("vec_id", X.r6(V.jaccard("a", "b")).alias("value"))


@query("P15_sparse_dot", f"""WITH {X.raw_sql()}, {_SHARED}
SELECT vec_id, round(s, 6) AS dot, round(s / (greatest(qa, 1e-8) * greatest(qb, 1e-8)), 6) AS cosine FROM both_""")
def p15(spark, sf):
    return _code_pairs(spark, sf).select("vec_id", X.r6(V.sparse_dot("a", "b")).alias("dot"),
                                         X.r6(V.sparse_cosine("a", "b")).alias("cosine"))


def _filtered(keep):
    def run(spark, sf):
        c = X.raw_codes(spark, sf, "vec_id").select("vec_id", keep("code").alias("code"))
        return C.active_features(c).select("vec_id", "feature_id", X.r6(F.col("weight").cast("double")).alias("weight"))
    return run


_CODE_ROWS = "SELECT vec_id, f::INTEGER AS feature_id, round(w::DOUBLE, 6) AS weight FROM codes"
query("P17_positive_weights", f"WITH {X.raw_sql()} {_CODE_ROWS} WHERE w > 0")(_filtered(V.positive_weights))
query("P18_nonzero_weights", f"WITH {X.raw_sql()} {_CODE_ROWS} WHERE w <> 0")(_filtered(V.nonzero_weights))


@query("P19_positive_scores", f"WITH {X.search_sql(X.raw_sql(), candidates='positive')} {X.RUN_ROWS}")
def p19(spark, sf):
    return X.run_rows(S.sparse_search(X.raw_codes(spark, sf, "q_idx"), X.raw_codes(spark, sf, "doc_idx"),
                                      X.TOP, candidates="positive"))


@query("P20_usable_samples", """SELECT conv_id, turn FROM conversations
WHERE trim(CASE WHEN role = 'system' THEN '  ' ELSE text END) <> '' AND role <> 'assistant'""")
def p20(spark, sf):
    from ..sources.records import usable_samples
    t = X.table(spark, sf, "conversations").withColumn(
        "caption", F.when(F.col("role") == "system", "  ").otherwise(F.col("text"))).withColumn(
        "has_image", F.col("role") != "assistant")
    return usable_samples(t, image_exists="has_image").select("conv_id", "turn")


@query("P22_truncate_dim", f"""WITH {X.LONG}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM vec WHERE f < 32 GROUP BY vec_id)
SELECT vec_id, f::INTEGER AS pos, round((x / (n + 1e-8))::FLOAT::DOUBLE, 6) AS x FROM vec JOIN n USING (vec_id) WHERE f < 32""")
def p22(spark, sf):
    e = X.table(spark, sf, "embeddings").select("vec_id", V.truncate_dim("embedding", 32).alias("v"))
    return e.select("vec_id", F.posexplode(V.l2_normalize("v")).alias("pos", "x")).select(
        "vec_id", "pos", X.r6(F.col("x").cast("double")).alias("x"))


@query("U6_sql_functions", f"""WITH {X.NEIGHBOURS} SELECT vec_id, round(list_dot_product(a, b), 6) AS dot,
round(list_distance(a, b), 6) AS l2, round(a[1] / (sqrt(list_dot_product(a, a)) + 1e-8), 6) AS first FROM pairs""")
def u6(spark, sf):
    V.register_sql_functions(spark)
    X.neighbours(spark, sf).createOrReplaceTempView("neighbours")
    return spark.sql("SELECT vec_id, round(vec_dot(a, b), 6) AS dot, round(vec_l2_distance(a, b), 6) AS l2, "
                     "round(vec_l2_normalize(a)[0], 6) AS first FROM neighbours")
