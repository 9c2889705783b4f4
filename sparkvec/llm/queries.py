"""The numbered queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exact_dedup, language, licenses, mixing, quality, simhash, site_tree, sketch, token_files, toxicity, vector_codes
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), bpe.digest,
                          "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@query("op2_mixing", r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, coalesce(source, '') AS source,
               greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')))::BIGINT AS tokens FROM documents),
    s AS (SELECT source, sum(tokens)::BIGINT AS n FROM d GROUP BY source),
    p AS (SELECT source, n, n / (SELECT sum(n) FROM s)::DOUBLE AS p FROM s),
    ends AS (SELECT min(p) AS least, max(p) AS most FROM p),
    bisect AS (
        SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
        UNION ALL
        SELECT step + 1, CASE WHEN pow(most / least, 1 - (low + high) / 2) <= 2 THEN low ELSE (low + high) / 2 END,
               CASE WHEN pow(most / least, 1 - (low + high) / 2) <= 2 THEN (low + high) / 2 ELSE high END
        FROM bisect, ends WHERE step < 36),
    e AS (SELECT CASE WHEN (SELECT most / least <= 2 FROM ends) THEN 0 ELSE round(high, 9) END AS a FROM bisect WHERE step = 36),
    z AS (SELECT sum(pow(p, a)) AS z, max(p / pow(p, a)) AS f FROM p, e),
    plan AS (
        SELECT source, n, round(pow(p, a) / z, 9) AS weight,
               round(pow(p, a) / z * ((SELECT sum(n) FROM s)::DOUBLE * z * f), 3) AS quota FROM p, e, z),
    plan2 AS (SELECT *, floor(quota / n)::BIGINT AS epochs, floor(quota - floor(quota / n) * n) AS rest FROM plan),
    keyed AS (
        SELECT d.*, weight, quota / n AS times, epochs, rest,
               ('0x' || substr(md5('0:' || epochs || ':' || doc_id), 1, 15))::BIGINT AS key FROM d JOIN plan2 USING (source)),
    cut AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY key) <= rest AS more FROM keyed),
    copies AS (SELECT *, unnest(range(epochs + more::BIGINT)) AS epoch FROM cut)
    SELECT doc_id, source, epoch::INTEGER AS epoch, tokens AS n_tokens, weight,
           round((epoch + ('0x' || substr(md5('0:' || epoch || ':' || doc_id), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE)
                 / times, 9) AS place
    FROM copies""")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, max_repetition=2.0).select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("_epoch").alias("epoch"),
        F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_place").alias("place"))


@query("op3_licenses")
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/thousands/hundreds; every hundredth document is its folder's licence file."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 1000).cast("string"),
                       F.floor(F.col("doc_id") / 100).cast("string"), name)
    return licenses.scan(docs.select(path.alias("path"), "text"))


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_folder(spark)
    token_files.write_with_library(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path, token_files.crc32, "bigint", "ids_crc32")


@query("op5_fingerprints")
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_edits(table(spark, sf_dir, "documents"))


@query("op6_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    WINDOW w AS (PARTITION BY t)""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest=True).drop("copies")


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), words=4, bits=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_main_text")
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_vector_codes", """
    WITH k AS (
        SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding AS e, len(embedding) // 16 AS w FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c AS MATERIALIZED (SELECT r, (i - 1) // w AS pos, (i - 1) % w AS place, floor(256 * e[i]::DOUBLE)::BIGINT AS x
                       FROM (SELECT r, e, w, unnest(range(1, len(e) + 1)) AS i FROM k)),
    b0 AS (SELECT pos, r AS entry, place, x FROM c WHERE r < 64),
    a0 AS MATERIALIZED (
        SELECT r, pos, first(entry ORDER BY d, entry) AS entry FROM (
            SELECT c.r, c.pos, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM c JOIN b0 b USING (pos, place) GROUP BY ALL) GROUP BY ALL),
    s0 AS (SELECT pos, entry, place, sum(x) AS s, count(*) AS n FROM a0 JOIN c USING (r, pos) GROUP BY ALL),
    b1 AS MATERIALIZED (SELECT pos, entry, place, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x
                        FROM b0 LEFT JOIN s0 USING (pos, entry, place)),
    a1 AS MATERIALIZED (
        SELECT r, pos, first(entry ORDER BY d, entry) AS entry FROM (
            SELECT c.r, c.pos, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM c JOIN b1 b USING (pos, place) GROUP BY ALL) GROUP BY ALL),
    s1 AS (SELECT pos, entry, place, sum(x) AS s, count(*) AS n FROM a1 JOIN c USING (r, pos) GROUP BY ALL),
    b2 AS MATERIALIZED (SELECT pos, entry, place, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x
                        FROM b1 LEFT JOIN s1 USING (pos, entry, place)),
    a2 AS (
        SELECT r, pos, first(entry ORDER BY d, entry) AS entry, min(d) AS d FROM (
            SELECT c.r, c.pos, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM c JOIN b2 b USING (pos, place) GROUP BY ALL) GROUP BY ALL),
    coded AS (SELECT r, string_agg(format('{:02x}', entry), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY pos, entry, place)) FROM b2) AS codebooks_sha256
    FROM coded JOIN k USING (r)""")
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query("op13_language")
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))
