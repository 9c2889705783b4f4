"""Evaluation suites: encode, search and score, for one method or many.

Inputs are `queries(q_idx, embedding)`, `docs(doc_idx, embedding)` and
`relevance(q_idx, doc_idx)`; results are runs and metric tables.
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import coding as C
from ..operators import metrics as M
from ..operators import search as S
from ..session import cut_lineage

# K values of the sparsity trade-off, stand-alone and inside the trainer.
TRADE_OFF_KS = (4, 8, 16, 32, 64, 128, 256)
TRAINER_KS = (4, 8, 16, 32, 64, 128)


def as_run(hits: DataFrame, method: str, k=None) -> DataFrame:
    return hits.select(
        F.lit(method).alias("method"),
        (F.col("k") if k is None else F.lit(k)).cast("int").alias("k"),
        "q_idx", "doc_idx", "rank", "score")


def judged(queries: DataFrame, relevance: DataFrame) -> DataFrame:
    """Only queries with a relevant document are searched; filtering first saves their encoding."""
    return queries.join(relevance.select("q_idx").distinct(), "q_idx", "left_semi")


def dense_run(queries: DataFrame, docs: DataFrame, top_k: int = 100, method: str = "dense", k: int = 0) -> DataFrame:
    return as_run(S.dense_search(queries, docs, top_k), method, k)


def sweep_ks(ks, coder: C.SparseCoder, within: bool = False) -> list[int]:
    """Distinct k values in ascending order, between 1 and the dictionary size."""
    out = sorted({coder.sparsity(k) for k in ks if not within or 0 < k <= coder.dict_size})
    if not out:
        raise ValueError("no k within the dictionary size")
    return out


def sparse_sweep(queries: DataFrame, docs: DataFrame, coder: C.SparseCoder, ks, top_k: int = 100,
                 scoring: str = "dot", positive_only: bool = True, method: str = "sparse", within: bool = False) -> DataFrame:
    """Rankings for every k from one encoding and one pass over the documents.

    TopK codes are nested, so the code for a smaller k is a prefix of the one for the largest. A k is
    clamped to the dictionary size and named as it is then; `within` drops larger ones instead.
    """
    ks = sweep_ks(ks, coder, within)
    q = C.encode(queries, coder, max(ks)).select("q_idx", "code")
    d = C.encode(docs, coder, max(ks)).select("doc_idx", "code")
    return as_run(S.sparse_search(
        q, d, top_k, scoring, "positive" if positive_only else "overlap", "clamp", ks=ks), method)


def sweep_stats(docs: DataFrame, coder: C.SparseCoder, ks, within: bool = False) -> DataFrame:
    """Index statistics of the document codes at every k, from one encoding."""
    ks = sweep_ks(ks, coder, within)
    long = C.active_features(C.encode(docs, coder, max(ks)).select("doc_idx", "code"))
    each = long.groupBy("feature_id", "code_rank").agg(F.count(F.lit(1)).alias("n"))
    cut = each.select("feature_id", "n", "code_rank", F.explode(F.array(*map(F.lit, ks))).alias("k")).where(
        F.col("code_rank") <= F.col("k"))
    per_feature = cut.groupBy("k", "feature_id").agg(F.sum("n").alias("n"))
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return per_feature.groupBy("k").agg(
        F.count(F.lit(1)).alias("features_used"), F.avg("n").alias("avg_posting_length"),
        F.sum("n").alias("total")).select(
        "k", "features_used", "avg_posting_length", (F.col("total") / n_docs).alias("avg_doc_length"))


def raw_topk_run(queries: DataFrame, docs: DataFrame, k: int, top_k: int = 100, method: str = "raw_topk") -> DataFrame:
    """Baseline without a coder: signed raw dimensions, every document rankable."""
    q = C.raw_topk_encode(queries, k).select("q_idx", "code")
    d = C.raw_topk_encode(docs, k).select("doc_idx", "code")
    return as_run(S.sparse_search(q, d, top_k, candidates="all"), method, k)


def raw_topk_sweep(queries: DataFrame, docs: DataFrame, ks, top_k: int = 100, method: str = "raw_topk") -> DataFrame:
    """`raw_topk_run` at every k from one encoding and one pass over the documents: raw codes are nested."""
    q = C.raw_topk_encode(queries, max(ks)).select("q_idx", "code")
    d = C.raw_topk_encode(docs, max(ks)).select("doc_idx", "code")
    return as_run(S.sparse_search(q, d, top_k, candidates="all", ks=list(ks)), method)


def projected_run(queries: DataFrame, docs: DataFrame, project, method: str, k: int, top_k: int = 100) -> DataFrame:
    """Dense search after `project(frame) -> frame with latent`."""
    q = project(queries).select("q_idx", F.col("latent").alias("embedding"))
    d = project(docs).select("doc_idx", F.col("latent").alias("embedding"))
    return dense_run(q, d, top_k, method, k)


def pca_run(queries: DataFrame, docs: DataFrame, k: int, top_k: int = 100,
            max_docs: int | None = None, seed: int = 42) -> DataFrame:
    """PCA at the memory of a k-sparse code: 2k numbers, at most the full dimension."""
    return pca_sweep(queries, docs, [k], top_k, max_docs, seed)


def pca_sweep(queries: DataFrame, docs: DataFrame, ks, top_k: int = 100, max_docs: int | None = None, seed: int = 42) -> DataFrame:
    """PCA at 2k numbers for every k, from one fit, one projection and one pass over the documents.

    The components for a smaller k are the first ones of those for the largest. Where 2k reaches the full dimension nothing is
    reduced, and the centred vectors themselves are compared.
    """
    sample = docs.select(F.col("doc_idx").alias("row_idx"), "embedding")
    found = docs.select(F.size("embedding").alias("d")).first()
    dim = found["d"] if found is not None else 0
    reduced = sorted(2 * k for k in ks if 2 * k < dim)
    whole = any(2 * k >= dim for k in ks)
    model = C.pca_fit(sample, reduced[-1] if reduced else dim, max_docs, seed)
    width = model.components.shape[1]
    if reduced and whole:
        model = C.PCAModel(model.mean, np.hstack([model.components, np.eye(dim)]), model.method, model.n_fit)
    slices = {int(k): (0, 2 * k) if 2 * k < dim else (width if reduced else 0, (width if reduced else 0) + dim) for k in ks}
    q = C.pca_project(queries, model).select("q_idx", F.col("latent").alias("embedding"))
    d = C.pca_project(docs, model).select("doc_idx", F.col("latent").alias("embedding"))
    return as_run(S.dense_search(q, d, top_k, slices=slices), "pca")


def stored_ae_run(queries: DataFrame, docs: DataFrame, model: C.DenseAE, k: int | None = None,
                  requested=None, top_k: int = 100, strict: bool = False) -> tuple[DataFrame, list[str]]:
    """Stored autoencoder; its size implies k = bottleneck/2. Returns the run and warnings."""
    implied = model.bottleneck // 2 if model.bottleneck % 2 == 0 else None
    warnings = []
    if k is None:
        k = implied if implied is not None else 0
    if strict and implied != k:
        raise ValueError(f"bottleneck {model.bottleneck} does not match k={k}")
    if requested is not None and implied not in requested:
        warnings.append(f"bottleneck {model.bottleneck} implies k={implied}, which was not requested")
    run = projected_run(queries, docs, lambda df: C.ae_encode(df, model), "dense_ae", k, top_k)
    return run, warnings


def reconstruction(dense: DataFrame, coder: C.SparseCoder, k: int | None = None, sample_std: bool = False) -> DataFrame:
    """Mean and deviation of cosine and L2 error between vectors and their reconstruction."""
    fwd = C.forward(dense, coder, k).select(
        V.cosine("embedding", "x_hat").alias("c"), V.l2_distance("embedding", "x_hat").alias("l"))
    std = F.stddev_samp if sample_std else F.stddev_pop
    return fwd.agg(F.avg("c").alias("mean_cosine"), std("c").alias("std_cosine"),
                   F.avg("l").alias("mean_l2"), std("l").alias("std_l2"))


def alignment(pairs: DataFrame, coder: C.SparseCoder, k: int | None = None) -> DataFrame:
    """How well both sides of `pairs(row_idx, image_emb, text_emb)` share features."""
    both = C.encode(C.encode(pairs, coder, k, "image_emb", "a"), coder, k, "text_emb", "b")
    per = both.select(V.jaccard("a", "b").alias("j"), V.sparse_cosine("a", "b").alias("s"),
                      V.cosine("image_emb", "text_emb").alias("d"))
    return per.agg(F.avg("j").alias("jaccard"), F.avg("s").alias("sparse_cosine"),
                   F.avg("d").alias("dense_cosine")).select(
        "jaccard", "sparse_cosine", "dense_cosine",
        (F.col("sparse_cosine") / F.greatest("dense_cosine", F.lit(V.EPS))).alias("retention"))


def selection_score(queries: DataFrame, docs: DataFrame, relevance: DataFrame, metric: str = "ndcg_at_10"):
    """Scoring function for model selection: the metric of a coder's ranking of the judged queries."""
    queries = judged(queries, relevance)

    def score(coder: C.SparseCoder) -> float:
        run = sparse_sweep(queries, docs, coder, [coder.k])
        row = M.ranking_metrics(run, relevance).first()
        return 0.0 if row is None else float(row[metric])  # a coder that retrieves nothing scores zero

    return score


def select_coder(queries: DataFrame, docs: DataFrame, relevance: DataFrame, coders: dict[str, C.SparseCoder],
                 metric: str = "ndcg_at_10", top_k: int = 100) -> DataFrame:
    """`place`, `coder`, `value` of the metric for every coder, and `chosen`: the best one, of equals the first.

    All coders are scored in one pass over the documents: the codes of a document stand side by side
    under feature numbers of their own, and a query is searched once per coder. A coder that retrieves nothing has 0.
    """
    first, spans = 0, []
    for coder in coders.values():
        spans.append(first)
        first += coder.dict_size
    if first >= 1 << 31:
        raise ValueError("the dictionaries have too many features together")
    n = len(coders)

    def shift(at):
        return lambda e: F.struct((e["feature_id"] + at).cast("int").alias("feature_id"), e["weight"].alias("weight"))

    def coded(df):
        for i, coder in enumerate(coders.values()):
            df = C.encode(df, coder, None, "embedding", f"code_{i}")
        return df, [F.transform(f"code_{i}", shift(at)) for i, at in enumerate(spans)]

    q, moved = coded(judged(queries, relevance).select("q_idx", "embedding"))
    q = q.select("q_idx", F.posexplode(F.array(*moved)).alias("place", "code")).select(
        (F.col("q_idx") * n + F.col("place")).alias("q_idx"), "code")
    d, moved = coded(docs.select("doc_idx", "embedding"))
    hits = S.sparse_search(q, d.select("doc_idx", F.concat(*moved).alias("code")), top_k, "dot", "positive")
    run = as_run(hits.withColumn("place", F.pmod("q_idx", F.lit(n))).withColumn("q_idx", F.floor(F.col("q_idx") / n)).withColumnRenamed(
        "place", "k"), "coder")
    scores = M.ranking_metrics(run, relevance, [("coder", i) for i in range(n)])
    names = scores.sparkSession.createDataFrame(list(enumerate(coders)), "k int, coder string")
    out = cut_lineage(scores.join(F.broadcast(names), "k").select(  # read for its best row too
        F.col("k").alias("place"), "coder", F.coalesce(metric, F.lit(0.0)).alias("value")))
    best = out.agg(F.max_by("place", F.struct("value", -F.col("place")))).scalar()
    return out.withColumn("chosen", F.col("place") == best)


class Stopwatch:
    """Materialises stages in the shared checkpoint folder and notes their wall time."""

    def __init__(self):
        self.rows: list[tuple] = []

    def run(self, df: DataFrame, method: str, k: int, stage: str) -> DataFrame:
        start = time.time()
        out = cut_lineage(df)
        self.rows.append((method, int(k), stage, time.time() - start))
        return out

    def seconds(self, method: str, stage: str) -> float:
        return sum(r[3] for r in self.rows if r[0] == method and r[2] == stage)

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "method string, k int, stage string, seconds double")


def sparse_vs_dense(queries: DataFrame, docs: DataFrame, relevance: DataFrame, coder: C.SparseCoder,
                    k: int | None = None, top_k: int = 100, scoring: str = "dot",
                    backend: str = "scan") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics of both methods, index statistics, and stage times with the speed-up ratio."""
    k = coder.sparsity(k)
    relevance = cut_lineage(relevance)
    queries = judged(queries, relevance)
    watch = Stopwatch()
    q = watch.run(C.encode(queries, coder, k).select("q_idx", "code"), "sparse", k, "encode_queries")
    d = watch.run(C.encode(docs, coder, k).select("doc_idx", "code"), "sparse", k, "encode_docs")
    index = S.build_index(d)
    sparse = watch.run(as_run(index.search(q, top_k, scoring, backend), "sparse", k), "sparse", k, "search")
    dense = watch.run(dense_run(queries, docs, top_k), "dense", 0, "search")
    ratio = watch.seconds("dense", "search") / max(watch.seconds("sparse", "search"), V.EPS)
    times = watch.frame(queries.sparkSession).withColumn("speedup", F.lit(ratio))
    return M.ranking_metrics(sparse.unionByName(dense), relevance), S.index_stats(index), times


def benchmark(queries: DataFrame, docs: DataFrame, relevance: DataFrame, ks, coder: C.SparseCoder | None = None,
              baselines=("pca", "raw_topk"), ae: C.DenseAE | None = None, fit_ae=None, match: str = "all",
              match_metric: str = "ndcg_at_10", top_k: int = 100, scoring: str = "dot",
              max_fit_docs: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every method on the same queries: (runs, metrics, timings).

    `ks[0]` is the primary k. Baselines run at the k values `match` selects from the sparse
    metrics. `fit_ae(docs, dim) -> DenseAE` adds the fitted autoencoder.
    """
    spark = queries.sparkSession
    watch = Stopwatch()
    relevance = cut_lineage(relevance)
    queries = cut_lineage(judged(queries, relevance))
    runs = [watch.run(dense_run(queries, docs, top_k), "dense", 0, "search")]
    matched = list(ks)
    if coder is not None:
        sparse = watch.run(sparse_sweep(queries, docs, coder, ks, top_k, scoring), "sparse", ks[0], "search")
        runs.append(sparse)
        scored = M.long_form(M.ranking_metrics(sparse, relevance))
        matched = sorted(r["k"] for r in M.matched_k(scored, match, match_metric, ks[0]).collect())
    if matched and "raw_topk" in baselines:
        runs.append(watch.run(raw_topk_sweep(queries, docs, matched, top_k), "raw_topk", matched[0], "search"))
    if matched and "pca" in baselines:
        runs.append(watch.run(pca_sweep(queries, docs, matched, top_k, max_fit_docs, seed), "pca", matched[0], "search"))
    for k in matched:
        if fit_ae is not None:
            dim = docs.select(F.size("embedding").alias("d")).first()["d"]
            model = fit_ae(docs.select(F.col("doc_idx").alias("row_idx"), "embedding"), min(2 * k, dim))
            runs.append(watch.run(projected_run(
                queries, docs, lambda df: C.ae_encode(df, model), "fitted_ae", k, top_k), "fitted_ae", k, "search"))
    if ae is not None:
        run, _ = stored_ae_run(queries, docs, ae, top_k=top_k)
        runs.append(watch.run(run, "dense_ae", 0, "search"))
    everything = runs[0]
    for r in runs[1:]:
        everything = everything.unionByName(r)
    wanted = [("dense", 0)] + ([("sparse", k) for k in sweep_ks(ks, coder)] if coder is not None else [])
    wanted += [(m, int(k)) for m in ("raw_topk", "pca") if m in baselines for k in matched]
    wanted += [("fitted_ae", int(k)) for k in matched if fit_ae is not None]
    if ae is not None:
        wanted.append(("dense_ae", ae.bottleneck // 2 if ae.bottleneck % 2 == 0 else 0))
    return everything, M.ranking_metrics(everything, relevance, wanted), watch.frame(spark)


def retrieval_benchmark(spark, query_path, candidate_path, qrels_path, factory, cache_path, output_path, ks,
                        coder: C.SparseCoder | None = None, tag: str = "sparkvec", batch_size: int = 256,
                        prefix: str = "", instruction: str = "", model_name: str = "", **options) -> DataFrame:
    """The whole job on files: read, embed or reuse, rank every method, write runs and report."""
    from ..functions import items as I
    from ..operators import relevance as R
    from ..sources import dense as D
    from ..sources import records, stores

    sides = {}
    for kind, path, text_prefix in (("query", query_path, prefix), ("candidate", candidate_path, "")):
        items = records.read_items(spark, path, kind)
        prompts = items.withColumn("text", I.prompt_text("text", "modality", text_prefix))
        expected = {"model_name": model_name, "batch_size": batch_size, "text_prefix": text_prefix,
                    "system_instruction": instruction, "id_sha256": D.manifest(
                        items.withColumn("embedding", F.array().cast("array<float>"))).first()["id_sha256"]}
        sides[kind] = D.embed_cached(prompts, factory, cache_path, kind, expected, batch_size=batch_size)
    qrels = records.read_qrels(spark, qrels_path, strict=True)
    ids = {kind: df.select("row_idx", "item_id") for kind, df in sides.items()}
    relevance = R.require_rows(cut_lineage(R.relevance_rows(qrels, ids["query"], ids["candidate"])),
                               "no query has a relevant document in the pool")
    queries = sides["query"].select(F.col("row_idx").alias("q_idx"), "embedding")
    docs = sides["candidate"].select(F.col("row_idx").alias("doc_idx"), "embedding")
    runs, metrics, times = benchmark(queries, docs, relevance, ks, coder, **options)
    long = cut_lineage(M.long_form(metrics))
    stores.write_report(long, times, f"{output_path}/report", primary_k=int(ks[0]), model_name=model_name, prefix=prefix,
                        instruction=instruction)
    named = (runs.join(ids["query"].select(F.col("row_idx").alias("q_idx"), F.col("item_id").alias("qid")), "q_idx")
             .join(ids["candidate"].select(F.col("row_idx").alias("doc_idx"), F.col("item_id").alias("did")), "doc_idx"))
    for r in long.select("method", "k").distinct().collect():  # one run folder per method and k
        own = named.where((F.col("method") == r["method"]) & (F.col("k") == r["k"]))
        stores.write_trec(own, f"{output_path}/runs/{r['method']}_k{r['k']}", f"{tag}_{r['method']}_k{r['k']}")
    return long
