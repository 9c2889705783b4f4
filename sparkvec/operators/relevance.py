"""Judgments joined to pools, positives, negatives, samples and splits.

Every random choice is an order by a seeded md5 key, so it is the same under any
partitioning and can be recomputed after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_int, hash_key
from ..session import cut_lineage

DRAW_ROUNDS = 8  # fixed value: attempts before the pool is enumerated
ROW_BLOCK = 1 << 16  # row indices generated by one task in the exhaustive fill
POOL_BYTES = 64 * 1024 * 1024  # largest pool of ids that is broadcast to the judgments


def pool_ids(items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """id -> row index; the last row of a repeated id wins."""
    return items.groupBy(F.col(id_col).alias("id")).agg(F.max("row_idx").alias("row_idx"))


def _relevant(qrels: DataFrame) -> DataFrame:
    return (qrels.where(F.col("rel") > 0) if "rel" in qrels.columns else qrels).select("qid", "did")


def _travels(pool: DataFrame, id_col: str, most: int) -> DataFrame:
    """`pool`, broadcast in joins if its ids and row indices take at most `most` bytes."""
    n, size = pool.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(id_col)), F.lit(0))).first()
    return F.broadcast(pool) if 32 * n + size <= most else pool


def relevance_rows(qrels: DataFrame, queries: DataFrame, docs: DataFrame, pool_bytes: int = POOL_BYTES) -> DataFrame:
    """Judgments with a positive rel, if it is given, whose query and document are both in the pools, as row indices.

    Queries without an in-pool relevant document vanish with the inner joins. Pools of up to `pool_bytes` travel to
    the judgments, so that of these only rows inside the pools are shuffled.
    """
    q = queries.select(F.col("item_id").alias("qid"), F.col("row_idx").alias("q_idx"))
    d = pool_ids(docs).select(F.col("id").alias("did"), F.col("row_idx").alias("doc_idx"))
    q, d = _travels(q, "qid", pool_bytes), _travels(d, "did", pool_bytes)
    return _relevant(qrels).join(q, "qid").join(d, "did").select("q_idx", "doc_idx").distinct()


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def judged_queries(queries: DataFrame, relevance: DataFrame) -> DataFrame:
    return queries.join(relevance.select(F.col("q_idx").alias("row_idx")), "row_idx", "left_semi")


def _annotated(queries: DataFrame, annotations: DataFrame, docs: DataFrame, column: str) -> DataFrame:
    ids = annotations.select("qid", F.explode(column).alias("did"))
    return relevance_rows(ids, queries, docs)


def positives(queries: DataFrame, docs: DataFrame, annotations: DataFrame, qrels: DataFrame) -> DataFrame:
    """Annotated or judged positives inside the pool."""
    ids = annotations.select("qid", F.explode("pos_ids").alias("did")).unionByName(
        _relevant(qrels))
    return relevance_rows(ids, queries, docs)


def explicit_negatives(queries: DataFrame, docs: DataFrame, annotations: DataFrame,
                       pos: DataFrame) -> DataFrame:
    """Annotated negatives inside the pool that are not positives, for queries with positives."""
    neg = _annotated(queries, annotations, docs, "neg_ids")
    return neg.join(pos, ["q_idx", "doc_idx"], "left_anti").join(
        pos.select("q_idx").distinct(), "q_idx", "left_semi")


def first_per_group(df: DataFrame, group: str, key, most: int, n=None) -> DataFrame:
    """The rows of each group with the smallest key: `most`, or the column `n` (at most `most`).

    The literal bound lets every map task drop all but its own first rows before the shuffle.
    """
    w = Window.partitionBy(group).orderBy(key)
    ranked = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return ranked if n is None else ranked.where(F.col("_r") <= n)


def _draw_distinct(need: DataFrame, used: DataFrame, n_docs: int, most: int, seed: int) -> DataFrame:
    """`need` distinct rows of the pool per query that are not `used`, as (q_idx, doc_idx, _r).

    Candidates are hashed row indices, as many per query as `need` distinct ones are expected to take; a query that
    stays short gets DRAW_ROUNDS times a fixed number. The smallest draw numbers are taken, so how many are drawn first
    decides no row. Only queries still short afterwards enumerate the pool; that happens when the used rows cover most
    of it or the pool itself is small, so the work stays proportional to the input. Draws and used rows of a query meet
    in one shuffle.
    """
    taken = used.where("q_idx IS NOT NULL AND doc_idx IS NOT NULL").select(
        "q_idx", F.col("doc_idx").cast("bigint").alias("doc_idx"), F.lit(-1).alias("draw"), F.lit(0).alias("need"))

    def draw(need: DataFrame, draws: Column) -> DataFrame:
        drawn = need.select("q_idx", F.col("need").cast("int").alias("need"), F.explode(F.sequence(F.lit(0), draws - 1)).alias("draw"))
        drawn = drawn.withColumn("doc_idx", F.pmod(hash_int(seed, F.lit("draw"), "q_idx", "draw"), F.lit(n_docs)))
        fresh = drawn.unionByName(taken).repartition("q_idx").groupBy("q_idx", "doc_idx").agg(
            F.min("draw").alias("draw"), F.max("need").alias("need")).where("draw >= 0")
        return cut_lineage(first_per_group(fresh, "q_idx", F.col("draw"), most, F.col("need")).select(
            "q_idx", "doc_idx", "_r"))

    def still_short(need: DataFrame, fill: DataFrame) -> DataFrame:
        got = fill.groupBy("q_idx").agg(F.count(F.lit(1)).alias("n_fill"))
        return cut_lineage(need.join(got, "q_idx", "left").where(
            F.coalesce("n_fill", F.lit(0)) < F.col("need")).select("q_idx", "need"))

    full = F.greatest(F.lit(32), 4 * F.col("need"))
    need = cut_lineage(need.select("q_idx", "need"))
    free = F.lit(float(n_docs)) - F.coalesce("n_used", F.lit(0))
    expected = F.when(free > F.col("need"), n_docs * F.log(free / (free - F.col("need"))))  # null: more than can be drawn
    first = F.least(full, F.coalesce(F.ceil(expected + 4 * F.sqrt(expected) + 8).cast("int"), full))
    fill = draw(need.join(used.groupBy("q_idx").agg(F.count(F.lit(1)).alias("n_used")), "q_idx", "left"), first)
    short = still_short(need, fill)
    if short.isEmpty():
        return fill
    fill = fill.join(short, "q_idx", "left_anti").unionByName(draw(short, DRAW_ROUNDS * full))
    short = still_short(short, fill)
    if short.isEmpty():
        return fill
    n_blocks = -(-n_docs // ROW_BLOCK)
    pool = short.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1)))))
    pool = pool.repartition(F.col("q_idx"), F.col("_b")).withColumn("doc_idx", F.explode(F.sequence(
        F.col("_b").cast("bigint") * ROW_BLOCK,
        F.least(F.lit(n_docs).cast("bigint"), (F.col("_b").cast("bigint") + 1) * ROW_BLOCK) - 1)))
    pool = pool.join(used, ["q_idx", "doc_idx"], "left_anti").withColumn(
        "_key", hash_key(seed, F.lit("pool"), "q_idx", "doc_idx"))
    rest = first_per_group(pool, "q_idx", F.col("_key"), most, F.col("need"))
    return fill.join(short, "q_idx", "left_anti").unionByName(rest.select("q_idx", "doc_idx", "_r"))


def sample_negatives(pos: DataFrame, neg: DataFrame, n_docs: int, n: int, seed: int) -> DataFrame:
    """`n` distinct non-positive documents per query: annotated ones first, then random fill.

    `pos` is read several times: pass a stored or checkpointed frame.
    """
    counts = pos.groupBy("q_idx").agg(F.count(F.lit(1)).alias("n_pos"))
    target = F.least(F.lit(n), F.greatest(F.lit(0), F.lit(n_docs) - F.col("n_pos")))
    want = counts.select("q_idx", target.cast("int").alias("target"))

    listed = neg.join(want, "q_idx").withColumn("_key", hash_key(seed, "q_idx", "doc_idx"))
    listed = cut_lineage(first_per_group(listed, "q_idx", F.col("_key"), n, F.col("target")).select(
        "q_idx", "doc_idx", F.col("_r").alias("pick")))
    taken = listed.groupBy("q_idx").agg(F.count(F.lit(1)).cast("int").alias("n_listed"))
    need = want.join(taken, "q_idx", "left").select(
        "q_idx", (F.col("target") - F.coalesce("n_listed", F.lit(0))).alias("need")).where(F.col("need") > 0)
    used = pos.select("q_idx", "doc_idx").unionByName(listed.select("q_idx", "doc_idx"))
    filled = _draw_distinct(need, used, n_docs, n, seed).join(taken, "q_idx", "left").select(
        "q_idx", "doc_idx", (F.col("_r") + F.coalesce("n_listed", F.lit(0))).alias("pick"))
    return listed.unionByName(filled)


def sample_triplets(pairs: DataFrame, n_pairs: int, n: int, seed: int, modality: str = "both",
                    exact: bool = False) -> DataFrame:
    """Per pair, n distinct random rows as negatives, minus the pair's own row.

    The own row is removed after the draw, so a pair can end with n-1 negatives;
    `exact` excludes it before. Text queries take image negatives and vice versa.
    """
    if modality not in ("both", "text", "image"):
        raise ValueError(f"unknown modality {modality!r}")
    if n > n_pairs - int(exact):
        raise ValueError("more negatives than rows")
    side = {"both": F.when(F.col("row_idx") % 2 == 0, F.lit("text")).otherwise(F.lit("image")),
            "text": F.lit("text"), "image": F.lit("image")}[modality]
    rows = pairs.select(F.col("row_idx").alias("q_idx"))
    own = rows.select("q_idx", F.col("q_idx").alias("doc_idx"))
    drawn = _draw_distinct(rows.withColumn("need", F.lit(n)), own if exact else own.where(F.lit(False)),
                           n_pairs, n, seed)
    return drawn.where(F.col("doc_idx") != F.col("q_idx")).select(
        F.col("q_idx").alias("row_idx"), F.col("_r").alias("draw"), F.col("doc_idx").alias("neg_idx")).withColumn(
        "query_side", side).withColumn("negative_side", F.when(
            F.col("query_side") == "text", F.lit("image")).otherwise(F.lit("text")))


def alignment_pairs(pos: DataFrame) -> DataFrame:
    return pos.groupBy("q_idx").agg(F.min("doc_idx").alias("doc_idx"))


def choose_positive(pos: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """One positive per query; min_by aggregates map-side, so a query with very many is no hot spot."""
    key = hash_key(seed, F.lit(epoch), "q_idx", "doc_idx")
    return pos.groupBy("q_idx").agg(F.min_by("doc_idx", key).alias("doc_idx"))


def training_rows(pos: DataFrame, negatives: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """`q_idx, pos_idx, neg_idx`: one positive per query and its sampled negatives in pick order."""
    listed = negatives.groupBy("q_idx").agg(F.array_sort(F.collect_list(F.struct("pick", "doc_idx"))).alias("n"))
    return choose_positive(pos, seed, epoch).join(listed, "q_idx", "left").select(
        "q_idx", F.col("doc_idx").alias("pos_idx"),
        F.coalesce(F.transform("n", lambda x: x["doc_idx"]), F.array().cast("array<bigint>")).alias("neg_idx"))


def attach_vectors(rows: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Training rows with vectors: `q_idx, q, p, neg`, joined last so that sampling moves ids only.

    A query's group holds its positive and the few sampled negatives. A document many
    queries point to is a skewed join key, which AQE splits on the id side.
    """
    slots = rows.select("q_idx", F.posexplode(F.concat(F.array("pos_idx"), F.col("neg_idx"))).alias("slot", "doc_idx"))
    entry = F.struct("slot", "embedding")
    found = slots.join(docs.select("doc_idx", "embedding"), "doc_idx").groupBy("q_idx").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["embedding"]).alias("v"))
    return found.join(queries.select("q_idx", F.col("embedding").alias("q")), "q_idx").select(
        "q_idx", "q", F.col("v")[0].alias("p"), F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))).alias("neg"))


def retrieval_split(queries: DataFrame, n: int, fraction: float, seed: int, split: str) -> DataFrame:
    """Seeded split of `queries(q_idx)`; validation size round(n*fraction) within [1, n-1].

    The validation rows are the `size` largest keys: a TakeOrdered, not a global sort.
    """
    if split not in ("train", "val", "all"):
        raise ValueError(f"unsupported split {split!r}")
    if split == "all":
        return queries
    size = 0 if n <= 1 else min(max(int(round(n * fraction)), 1), n - 1)
    if size == 0:
        return queries if split == "train" else queries.where(F.lit(False))
    keyed = queries.withColumn("_key", hash_key(seed, "q_idx"))
    bound = _kth_key(keyed, "_key", size)
    chosen = F.col("_key") >= bound if split == "val" else F.col("_key") < bound
    return keyed.where(chosen).drop("_key")


def _kth_key(keyed: DataFrame, key: str, size: int):
    """Smallest key among the `size` largest: bucket counts first, then one bucket is sorted."""
    prefix = F.substring(key, 1, 4)
    counts = sorted(((r[0], r[1]) for r in keyed.groupBy(prefix.alias("p")).count().collect()),
                    reverse=True)  # at most 65,536 hex prefixes
    left = size
    for p, c in counts:
        if left <= c:
            last = keyed.where(prefix == p).orderBy(F.col(key).desc()).limit(left)
            return last.agg(F.min(key)).scalar()
        left -= c
    raise ValueError("size exceeds the number of rows")


def seeded_sample(rows: DataFrame, n_rows: int, size: int, seed: int) -> DataFrame:
    """`size` rows without replacement; all rows if there are not more."""
    if size >= n_rows:
        return rows
    keyed = rows.withColumn("_key", hash_key(seed, "row_idx"))
    bound = _kth_key(keyed, "_key", size)
    return keyed.where(F.col("_key") >= bound).drop("_key")


def paired_split(rows: DataFrame, n: int, fraction: float, split: str) -> DataFrame:
    """The last int(n*fraction) rows are validation."""
    first_val = n - int(n * fraction)
    if split not in ("train", "val", "all"):
        raise ValueError(f"unsupported split {split!r}")
    if split == "all":
        return rows
    return rows.where(F.col("row_idx") >= first_val if split == "val" else F.col("row_idx") < first_val)


def positional_relevance(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("row_idx").alias("q_idx"), F.col("row_idx").alias("doc_idx"))
