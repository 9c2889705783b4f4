"""Sources, sinks and manifests, each over data written from the test tables."""

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators.embed import HashingEmbedder
from ..sources import dense as D
from ..sources import records as R
from ..sources import synthetic
from . import inputs as X
from .registry import query


def _write_lines(df, order, path):
    """JSON lines in the order of a column, over several files with blank lines between rows."""
    body = [c for c in df.columns if c != order]
    lines = df.repartitionByRange(4, order).sortWithinPartitions(order).select(
        F.concat(F.to_json(F.struct(*body)), F.when(F.col(order) % 5 == 0, F.lit("\n")).otherwise(F.lit(""))).alias("value"))
    lines.write.mode("overwrite").text(path)
    return path


def _candidate_file(spark, sf):
    """All candidate records: documents by id, then pages by id."""
    number = F.substring("did", 2, 20).cast("bigint")
    items = X.candidates(spark, sf).withColumn("n", F.when(F.col("did").startswith("p"), F.lit(1 << 50)).otherwise(0) + number)
    return _write_lines(items, "n", X.scratch(spark, "items") + "/lines")


_ITEM_ROWS = """(SELECT 'd' || doc_id AS did, doc_id AS row_idx FROM documents UNION ALL
  SELECT 'p' || page_id, (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY page_id) - 1 FROM pages)"""


@query("S1_read_items", f"""WITH {X.CANDIDATES} SELECT p.did AS item_id, row_idx, md5(coalesce(p.txt, '')) AS text_md5,
array_to_string(modes, ',') AS modality FROM prompts p JOIN {_ITEM_ROWS} USING (did)""")
def s1(spark, sf):
    items = R.read_items(spark, _candidate_file(spark, sf), "candidate")
    return items.select("item_id", "row_idx", F.md5(F.col("text").cast("binary")).alias("text_md5"),
                        F.array_join("modality", ",").alias("modality"))


@query("S1_small_splits", f"SELECT did AS item_id, row_idx FROM {_ITEM_ROWS}")
def s1_splits(spark, sf):
    """File order must not depend on how the files are split."""
    path = _candidate_file(spark, sf)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(64 * 1024))
    try:  # scan splits are planned when the frame is first executed
        items = R.read_items(spark, path, "candidate").select("item_id", "row_idx")
        out = X.scratch(spark, "rows")
        items.write.mode("overwrite").parquet(out)
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(out)


def _annotation_rows(spark, sf):
    """Conversation turns as annotation records: the last turn of a conversation wins."""
    t = X.table(spark, sf, "conversations")
    return t.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("n"),
        F.when(F.col("role") == "system", F.lit(None)).otherwise(F.col("conv_id").cast("string")).alias("qid"),
        F.array(F.concat("role", F.lit("-"), "turn")).alias("pos_cand_list"))


@query("S2_read_annotations", """SELECT conv_id::VARCHAR AS qid, arg_max(role || '-' || turn, turn) AS positive
FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def s2(spark, sf):
    path = _write_lines(_annotation_rows(spark, sf), "n", X.scratch(spark, "annotations") + "/lines")
    return R.read_annotations(spark, path).select("qid", F.col("pos_ids")[0].alias("positive"))


_REL = """CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN '2' WHEN 4 THEN '-1' WHEN 5 THEN '1' ELSE '3' END"""
_LOOSE = """CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN 'x' WHEN 4 THEN '-1.5' WHEN 5 THEN '0.5' ELSE '1.0 extra' END"""


def _qrels_file(spark, sf, rel):
    li = X.table(spark, sf, "lineitem")
    path = X.scratch(spark, "qrels") + "/lines"
    li.select(F.concat(F.lit("  "), "l_orderkey", F.lit("\t0 "), F.expr(
        f"CASE WHEN l_linenumber = 7 THEN '' ELSE concat(l_partkey, ' ', "
        f"{_LOOSE if rel == 'loose' else _REL}) END")).alias("value")).write.text(path)
    return path


@query("S3_qrels_lenient", f"""SELECT l_orderkey::VARCHAR AS qid, l_partkey::VARCHAR AS did,
CASE l_linenumber WHEN 1 THEN 1e0 WHEN 5 THEN 0.5e0 ELSE 1e0 END AS rel FROM lineitem WHERE l_linenumber IN (1, 5, 6)""")
def s3(spark, sf):
    return R.read_qrels(spark, _qrels_file(spark, sf, "loose"))


@query("S4_qrels_strict", f"""SELECT DISTINCT l_orderkey::VARCHAR AS qid, l_partkey::VARCHAR AS did FROM lineitem
WHERE ({_REL})::INT > 0 AND l_linenumber <> 7""")
def s4(spark, sf):
    return R.read_qrels(spark, _qrels_file(spark, sf, "strict"), strict=True).select("qid", "did")


def _raw_cache(spark, sf):
    """Vectors as a headerless float32 file with unused rows at the end, ids and metadata beside it."""
    import json
    path = X.scratch(spark, "raw")
    rows = X.item_rows(spark, sf).join(X.vectors(spark, sf, "row_idx"), "row_idx")
    n = rows.count()
    D.write_raw_matrix(rows, "embedding", f"{path}/doc_embeddings.npy", n, X.DIM, spare_rows=7)
    # the id list of this format is one JSON array, written by the driver
    ids = [str(r[0]) for r in rows.select("item_id").orderBy("row_idx").toLocalIterator()]
    for name, body in (("doc_ids.json", ids), ("doc_meta.json", {"count": n, "embedding_dim": X.DIM})):
        with open(f"{path}/{name}", "w") as f:
            json.dump(body, f)
    return path


@query("S6_raw_dense_cache", f"WITH {X.LONG} SELECT vec_id::VARCHAR AS item_id, vec_id AS row_idx, f::INTEGER AS pos, round(x, 6) AS x FROM vec")
def s6(spark, sf):
    cache = D.read_raw_dense(spark, _raw_cache(spark, sf), "doc", split_bytes=1 << 15)
    return cache.select("item_id", "row_idx", F.posexplode("embedding").alias("pos", "x")).select(
        "item_id", "row_idx", "pos", X.r6(F.col("x").cast("double")).alias("x"))


@query("S7_raw_pairs", f"WITH {X.NEIGHBOURS} SELECT vec_id AS row_idx, round(list_dot_product(a, b), 6) AS dot FROM pairs")
def s7(spark, sf):
    import json
    path = X.scratch(spark, "pairs")
    rows = X.neighbours(spark, sf).select(F.col("vec_id").alias("row_idx"), "a", "b")
    n = rows.count()
    D.write_raw_matrix(rows, "a", f"{path}/image_embeddings.npy", n, X.DIM)
    D.write_raw_matrix(rows, "b", f"{path}/text_embeddings.npy", n, X.DIM)
    with open(f"{path}/metadata.json", "w") as f:
        json.dump({"num_samples": n, "embedding_dim": X.DIM}, f)
    return D.read_pairs(spark, path, split_bytes=1 << 15).select(
        "row_idx", X.r6(V.dot("image_emb", "text_emb")).alias("dot"))


@query("S9_captions", """SELECT '/data/' || CASE WHEN conv_id % 2 = 0 THEN 'val2014' ELSE 'train2014' END || '/COCO_'
|| CASE WHEN conv_id % 2 = 0 THEN 'val2014' ELSE 'train2014' END || '_' || conv_id || '.jpg' AS path, turn AS sentid,
md5(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS caption_md5
FROM conversations WHERE conv_id % 4 IN (0, 1) AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant')""")
def s9(spark, sf):
    """Conversations as images with sentences; those without an answer have no image."""
    t = X.table(spark, sf, "conversations")
    name = F.expr("concat('COCO_', CASE WHEN conv_id % 2 = 0 THEN 'val2014' ELSE 'train2014' END, '_', conv_id, '.jpg')")
    sentence = F.struct(F.array("role").alias("tokens"), F.concat(F.lit(" "), "text").alias("raw"),
                        F.col("conv_id").alias("imgid"), F.col("turn").alias("sentid"))
    images = t.groupBy("conv_id").agg(F.collect_list(sentence).alias("sentences")).select(F.struct(
        name.alias("filename"), F.element_at(F.array(*map(F.lit, ("train", "restval", "val", "test"))),
                                             (F.col("conv_id") % 4 + 1).cast("int")).alias("split"),
        F.col("conv_id").alias("imgid"), F.col("conv_id").alias("cocoid"), "sentences").alias("i"))
    path = X.scratch(spark, "captions") + "/json"
    images.select(F.array("i").alias("images")).write.json(path)
    listing = t.where(F.col("role") == "assistant").select(F.concat(
        F.lit("/data/"), F.expr("CASE WHEN conv_id % 2 = 0 THEN 'val2014' ELSE 'train2014' END"), F.lit("/"), name).alias("path"))
    nested = spark.read.schema(R.CAPTION_SCHEMA).json(path)
    return R.captions(nested, "train", "/data", listing.distinct()).select(
        "path", "sentid", F.md5(F.col("caption").cast("binary")).alias("caption_md5"))


@query("S11_attach_images", """SELECT page_id, CASE WHEN url NOT LIKE '%/fr/%' THEN md5(html) END AS image_md5 FROM pages""")
def s11(spark, sf):
    """Pages stored as one file each stand in for images; the French ones are missing."""
    root = X.scratch(spark, "images")
    pages = X.table(spark, sf, "pages")

    def store(batches):
        for batch in batches:
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(f"{root}/{page_id}.bin", "wb") as f:
                    f.write(html.encode())
            yield batch.select(["page_id"])

    pages.where("url NOT LIKE '%/fr/%'").select("page_id", "html").mapInArrow(store, "page_id bigint").count()
    items = pages.select("page_id", F.concat("page_id", F.lit(".bin")).alias("image_path"))
    return R.attach_images(items, root).select("page_id", F.md5("image").alias("image_md5"))


_UNIFORM = "(('0x' || substr(md5('42:' || vec_id || ':' || side || ':' || f || ':{}'), 1, 15))::BIGINT + 0.5e0) / 1152921504606846976e0"


@query("S13_correlated_pairs", f"""WITH {X.LONG}, drawn AS (
  SELECT vec_id, side, f, x, 0.7e0 * x + (1 - 0.7e0) * (sqrt(-2 * ln({_UNIFORM.format('r')})) * cos(2 * pi() * ({_UNIFORM.format('a')})) / 8) AS v
  FROM vec, (SELECT unnest([1, 2]) AS side)),
n AS (SELECT vec_id, side, sqrt(sum(v * v)) + 1e-8 AS n FROM drawn GROUP BY ALL),
side AS (SELECT vec_id, side, f, x, (v / n)::FLOAT::DOUBLE AS w FROM drawn JOIN n USING (vec_id, side)),
wide AS (SELECT vec_id, f, max(x) AS x, max(CASE WHEN side = 1 THEN w END) AS a, max(CASE WHEN side = 2 THEN w END) AS b FROM side GROUP BY vec_id, f)
SELECT vec_id AS row_idx, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS paired_cosine,
  round(sum(a * x) / (sqrt(sum(a * a)) * sqrt(sum(x * x))), 6) AS source_cosine FROM wide GROUP BY vec_id""")
def s13(spark, sf):
    """Two noisy copies of every stored vector: how close they stay to it and to each other."""
    e = X.vectors(spark, sf, "row_idx")
    pairs = synthetic.correlated_pairs(e, X.DIM, shared="embedding").join(e, "row_idx")
    return pairs.select("row_idx", X.r6(V.cosine("image_emb", "text_emb")).alias("paired_cosine"),
                        X.r6(V.cosine("image_emb", "embedding")).alias("source_cosine"))


@query("S13_planted_retrieval", "SELECT count(*)::BIGINT AS queries, count(*)::BIGINT AS found FROM embeddings")
def s13_planted(spark, sf):
    """Noisy copies as queries: each must find its source first, far ahead of the other vectors."""
    from ..operators import search as S
    e = X.vectors(spark, sf, "row_idx")
    noisy = synthetic.correlated_pairs(e, X.DIM, r=0.9, shared="embedding").select(
        F.col("row_idx").alias("q_idx"), F.col("image_emb").alias("embedding"))
    hits = S.dense_search(noisy, e.withColumnRenamed("row_idx", "doc_idx"), 1)
    return hits.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("q_idx") == F.col("doc_idx")).alias("found"))


# ---------------------------------------------------------------- manifests and caches

_DIGEST = "sha256(string_agg(vec_id::VARCHAR, chr(10) ORDER BY vec_id))"


def _dense_rows(spark, sf):
    return X.item_rows(spark, sf).join(X.vectors(spark, sf, "row_idx"), "row_idx")


@query("K1_write_dense", f"WITH {X.LONG} SELECT 'doc' AS kind, vec_id AS row_idx, vec_id::VARCHAR AS item_id, round(sum(x), 5) AS total FROM vec GROUP BY vec_id")
def k1(spark, sf):
    path = X.scratch(spark, "dense")
    rows = _dense_rows(spark, sf)
    D.write_dense(rows, path, "doc", X.item_rows(spark, sf), model_name="m")
    return D.read_dense(spark, path, "doc").select("kind", "row_idx", "item_id", F.round(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("K2_manifest", f"""SELECT 3::INTEGER AS cache_version, 'm' AS model_name, 8::INTEGER AS batch_size, '' AS system_instruction,
'' AS text_prefix, 'doc' AS kind, count(*)::BIGINT AS count, 64::INTEGER AS embedding_dim, (SELECT sha256(string_agg(d, chr(10) ORDER BY r)) FROM (
    SELECT vec_id // 1048576 AS r, {_DIGEST} AS d FROM embeddings GROUP BY ALL)) AS id_sha256,
min(vec_id)::VARCHAR AS first_id, max(vec_id)::VARCHAR AS last_id FROM embeddings""")
def k2(spark, sf):
    return D.manifest(_dense_rows(spark, sf), model_name="m", batch_size=8, kind="doc")


@query("K2_ranged_digest", """SELECT sha256(string_agg(d, chr(10) ORDER BY r)) AS id_sha256 FROM (
SELECT doc_id // 1048576 AS r, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id)) AS d FROM documents GROUP BY ALL)""")
def k2_ranged(spark, sf):
    ids = X.table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("item_id"))
    return D.ranged_digest(ids)


@query("K3_validate_cache", """SELECT 'count' AS field, '3' AS expected, count(*)::VARCHAR AS actual FROM embeddings
UNION ALL SELECT 'model_name', 'other', 'm'""")
def k3(spark, sf):
    path = X.scratch(spark, "dense")
    D.write_dense(_dense_rows(spark, sf), path, "doc", model_name="m")
    return D.validate_cache(spark, path, "doc", {
        "count": 3, "model_name": "other", "embedding_dim": X.DIM, "text_prefix": None, "kind": "doc"})


@query("E8_embed_cached", "SELECT doc_id AS row_idx, doc_id::VARCHAR AS item_id, 64::INTEGER AS dim FROM documents")
def e8(spark, sf):
    path = X.scratch(spark, "cached")
    items = X.table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("item_id"), "text")
    expected = {"model_name": "hashing", "batch_size": 256, "text_prefix": ""}
    for _ in range(2):  # the second call finds the cache and embeds nothing
        out = D.embed_cached(items, lambda: HashingEmbedder(64), path, "doc", expected)
    return out.select("row_idx", "item_id", F.size("embedding").alias("dim"))
