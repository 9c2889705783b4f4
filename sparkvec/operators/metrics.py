"""Ranking metrics over `run(method, k, q_idx, doc_idx, rank)` and `relevance(q_idx, doc_idx)`."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import EPS

# Cuts at which recall and hit rate are reported, and the nDCG cut.
CUTS = (1, 5, 10, 100)
NDCG_CUT = 10
JUDGMENTS = 500_000  # most judgments that are broadcast to a run


def relevant_hits(run: DataFrame, relevance: DataFrame, most: int = JUDGMENTS) -> DataFrame:
    """Rows of the run whose document is relevant to their query. `relevance` is counted first: pass a stored frame.

    A search returns many hits a query, and Spark's estimate of its size, taken from the queries', is far too small: left to
    itself the join could send the whole run through the driver. Here up to `most` judgments travel to the run; more
    meet it in a sort-merge join.
    """
    judged = relevance.select("q_idx", "doc_idx")
    return run.join(judged.hint("broadcast" if judged.count() <= most else "merge"), ["q_idx", "doc_idx"])


def per_query(run: DataFrame, relevance: DataFrame) -> DataFrame:
    """Hits, first relevant rank and gain per (method, k, query); the run is read once.

    The join key (query, document) is fine-grained on both sides, so a query that
    owns a large share of the judgments is spread like any other rows.
    """
    marked = run.select("method", "k", "q_idx", "doc_idx", "rank").join(
        relevance.withColumn("hit", F.lit(True)), ["q_idx", "doc_idx"], "left")
    rank = F.when(F.col("hit"), F.col("rank"))
    return marked.groupBy("method", "k", "q_idx").agg(
        *[F.count_if(rank <= c).alias(f"hits_{c}") for c in CUTS], F.min(rank).alias("first_rank"),
        F.sum(F.when(rank <= NDCG_CUT, 1.0 / F.log2(rank + 1)).otherwise(0.0)).alias("dcg"))


def ranking_metrics(run: DataFrame, relevance: DataFrame, wanted: list[tuple[str, int]] | None = None) -> DataFrame:
    """Micro recall and hit rate at each cut, MRR and nDCG@10; one row per (method, k).

    A (method, k) of `wanted` whose run has no rows scores 0. Every judged query counts, also those for which nothing was retrieved.
    Without judged queries there is no value (null), except hit rate, which is 0.
    """
    sizes = relevance.groupBy("q_idx").agg(F.count(F.lit(1)).alias("n_rel"))
    totals = sizes.agg(F.struct(F.count(F.lit(1)).alias("nq"), F.coalesce(
        F.sum("n_rel"), F.lit(0)).alias("rel")).alias("t")).scalar()
    ideal, table = 0.0, []
    for i in range(1, NDCG_CUT + 1):
        ideal += 1.0 / math.log2(i + 1)
        table.append(F.lit(ideal))
    best = F.element_at(F.array(*table), F.least(F.col("n_rel"), F.lit(NDCG_CUT)).cast("int"))
    scored = per_query(run, relevance).join(sizes, "q_idx", "left").withColumn(
        "ndcg", F.when(F.col("n_rel").isNotNull(), F.col("dcg") / F.greatest(best, F.lit(EPS))))
    sums = scored.groupBy("method", "k").agg(
        *[F.sum(f"hits_{c}").alias(f"h{c}") for c in CUTS],
        *[F.count_if(F.col("first_rank") <= c).alias(f"q{c}") for c in CUTS],
        F.coalesce(F.sum(1.0 / F.col("first_rank")), F.lit(0.0)).alias("rr"),
        F.coalesce(F.sum("ndcg"), F.lit(0.0)).alias("ndcg"))
    if wanted:
        names = run.sparkSession.createDataFrame(sorted(set(wanted)), "method string, k int")
        sums = sums.join(F.broadcast(names), ["method", "k"], "full").na.fill(0)
    sums = sums.withColumn("t", totals)
    per = F.nullif(F.col("t.nq"), F.lit(0))
    return sums.select(
        "method", "k",
        *[(F.col(f"h{c}") / F.greatest("t.rel", F.lit(1))).alias(f"recall_at_{c}") for c in CUTS],
        *[F.coalesce(F.col(f"q{c}") / per, F.lit(0.0)).alias(f"hit_rate_at_{c}") for c in CUTS],
        (F.col("rr") / per).alias("mrr"), (F.col("ndcg") / per).alias("ndcg_at_10"))


METRICS = ([f"recall_at_{c}" for c in CUTS] + [f"hit_rate_at_{c}" for c in CUTS]
           + ["mrr", "ndcg_at_10"])


def long_form(metrics: DataFrame) -> DataFrame:
    """(method, k, metric, value), one row per metric."""
    return metrics.unpivot(["method", "k"], METRICS, "metric", "value")


def macro_recall(run: DataFrame, relevance: DataFrame, cut: int) -> DataFrame:
    """Recall averaged per query instead of pooled."""
    sizes = relevance.groupBy("q_idx").agg(F.count(F.lit(1)).alias("n_rel"))
    n = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    hits = run.where(F.col("rank") <= cut).join(relevance, ["q_idx", "doc_idx"]).groupBy(
        "method", "k", "q_idx").agg(F.count(F.lit(1)).alias("h"))
    return hits.join(sizes, "q_idx").groupBy("method", "k").agg(
        F.sum(F.col("h") / F.col("n_rel")).alias("s")).select(
        "method", "k", (F.col("s") / n).alias(f"macro_recall_at_{cut}"))


def retention(metrics_long: DataFrame, base: str = "dense") -> DataFrame:
    """Value of every method relative to the base method's; the metrics are computed once."""
    of_base = F.max(F.when(F.col("method") == base, F.col("value"))).over(Window.partitionBy("metric"))
    return metrics_long.withColumn("base_value", of_base).where(
        (F.col("method") != base) & F.col("base_value").isNotNull()).select(
        "method", "k", "metric",
        (F.col("value") / F.greatest("base_value", F.lit(EPS))).alias("retention"))


def matched_k(metrics_long: DataFrame, mode: str, metric: str = "ndcg_at_10",
              primary: int | None = None) -> DataFrame:
    """The k values other methods are compared at: all of them, the first, or the best by a metric that every k must have."""
    if mode == "all":
        return metrics_long.select("k").distinct()
    if mode == "primary":
        if primary is None:
            raise ValueError("mode 'primary' needs the primary k")
        return metrics_long.where(F.col("k") == primary).select("k").distinct()
    if mode != "best":
        raise ValueError(f"unknown mode {mode!r}")
    own = F.col("metric") == metric
    chosen = metrics_long.agg(
        F.max_by("k", F.when(own, F.struct("value", -F.col("k")))).alias("k"),
        (F.count_distinct("k") > F.count_distinct(F.when(own, F.col("k")))).alias("lacking"))
    return chosen.select(F.when(F.col("lacking") | F.col("k").isNull(), F.raise_error(
        F.lit(f"no metric {metric} at some k")).cast("int")).otherwise(F.col("k")).alias("k"))


def trec_lines(run: DataFrame, tag: str, real_score: bool = False) -> DataFrame:
    """`qid Q0 did rank score tag`; the score is 1/rank unless the real one is asked for."""
    score = F.col("score") if real_score else 1.0 / F.col("rank")
    return run.select("qid", "rank", F.format_string(
        "%s Q0 %s %d %.6f %s", "qid", "did", "rank", score, F.lit(tag)).alias("line"))


def steps_since_active(activity: DataFrame, n_steps: int, features: DataFrame | int) -> DataFrame:
    """For `activity(step, feature_id)` rows of active features: steps since each was last active.

    `features(feature_id)` are those that exist, or the size of a dictionary numbered from 0. Features
    never seen have been inactive for all `n_steps` steps.
    """
    last = activity.groupBy("feature_id").agg(F.max("step").alias("last_step"))
    every = features if isinstance(features, DataFrame) else activity.sparkSession.range(features).select(
        F.col("id").cast("int").alias("feature_id"))
    return every.join(last, "feature_id", "left").select(
        "feature_id", F.coalesce(F.lit(n_steps - 1) - F.col("last_step"), F.lit(n_steps)).alias("gap"))


def running_gap(activity: DataFrame) -> DataFrame:
    """Steps since the last activity, at every observed step of every feature.

    Before its first activity a feature counts from the start. Rows are first reduced to
    one per feature and step, so a window never holds more rows than there are steps.
    """
    activity = activity.groupBy("feature_id", "step").agg(F.bool_or("active").alias("active"))
    w = (Window.partitionBy("feature_id").orderBy("step")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return activity.select(
        "feature_id", "step",
        F.coalesce(F.col("step") - F.max(F.when(F.col("active"), F.col("step"))).over(w),
                   F.col("step") + 1).alias("gap"))


def dead_fraction(gaps: DataFrame, threshold: int = 1000) -> DataFrame:
    return gaps.agg(F.avg((F.col("gap") > threshold).cast("double")).alias("dead_fraction"))
