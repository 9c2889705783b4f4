"""Training objectives as aggregates over tables of vectors and codes."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.hashing import hash_int
from ..session import cut_lineage
from . import blocks
from . import coding as C


def recon_loss(fwd: DataFrame, x: str = "embedding", x_hat: str = "x_hat") -> DataFrame:
    return fwd.agg(F.avg(F.lit(1.0) - V.cosine(x, x_hat)).alias("recon"))


def align_term(a: str, b: str) -> Column:
    """Features that only one code has, plus half the magnitude differences on shared features."""
    fa, fb = V.features(a), V.features(b)
    pattern = F.size(F.array_except(fa, fb)) + F.size(F.array_except(fb, fa))
    lookup = F.map_from_entries(F.transform(b, lambda e: F.struct(
        e["feature_id"], F.abs(e["weight"].cast("double")))))
    magnitude = F.aggregate(a, F.lit(0.0), lambda acc, e: acc + F.coalesce(
        F.abs(F.abs(e["weight"].cast("double")) - F.try_element_at(lookup, e["feature_id"])), F.lit(0.0)))
    return pattern + 0.5 * magnitude


def align_loss(codes_a: DataFrame, codes_b: DataFrame, key: str = "row_idx") -> DataFrame:
    """Mean pattern difference plus half the mean magnitude difference on shared features.

    Both frames carry one packed code per pair; the pairs meet once and the features are
    compared inside the row, so nothing is exploded.
    """
    pairs = codes_a.select(key, F.col("code").alias("a")).join(
        codes_b.select(key, F.col("code").alias("b")), key)
    return pairs.agg(F.avg(align_term("a", "b")).alias("align"))


def distill_loss(pairs: DataFrame) -> DataFrame:
    """Mean squared gap between sparse and dense similarity of `q_emb, p_emb, q_code, p_code`."""
    gap = V.sparse_dot("q_code", "p_code") - V.dot("q_emb", "p_emb")
    return pairs.agg(F.avg(gap * gap).alias("distill"))


def _batch_matrices(columns: list[pa.ChunkedArray]) -> list[np.ndarray]:
    """Vector columns as matrices; code columns over the features the batch uses."""
    columns = [c.combine_chunks() for c in columns]
    if not pa.types.is_struct(columns[0].type.value_type):
        return [blocks.list_matrix(c) for c in columns]
    codes = [blocks.code_arrays(c) for c in columns]
    used = np.unique(np.concatenate([f for _, f, _ in codes]))
    out = []
    for offsets, features, weights in codes:
        m = np.zeros((len(offsets) - 1, len(used)))
        m[np.repeat(np.arange(len(m)), np.diff(offsets)), np.searchsorted(used, features)] = weights
        out.append(m)
    return out


def assign_batches(rows: DataFrame, key: str, n_rows: int, batch_size: int = 512, seed: int = 0) -> DataFrame:
    """Hash rows with a unique key into batches of about `batch_size`, whatever the data looks like."""
    n = max(1, round(n_rows / batch_size))
    return rows.withColumn("batch", F.pmod(hash_int(seed, key), F.lit(n)).cast("int"))


def contrastive_terms(rows: DataFrame, temperature: float = 0.05, normalize: bool = False) -> DataFrame:
    """Per query `loss` of its positive against the other positives of its batch.

    `rows(batch, q_idx, q, p[, neg])`: vectors or packed codes; `neg` is an array of them.
    Batches come from `assign_batches` and have a bounded size, so one batch is one task-sized group and
    the score matrix never leaves it. With `neg` the explicit negatives are appended and
    the query's own diagonal entry is not counted twice.
    """
    has_neg = "neg" in rows.columns

    def run(table: pa.Table) -> pa.Table:
        columns = [table["q"], table["p"]]
        if has_neg:
            nested = table["neg"].combine_chunks()
            columns.append(pa.chunked_array([nested.flatten()]))
            owner = np.repeat(np.arange(len(nested)), np.diff(nested.offsets.to_numpy()))
        q, p, *neg = _batch_matrices(columns)
        if normalize:
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
            p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
        logits = q @ p.T / temperature
        positive = np.diag(logits).copy()
        peak = logits.max(axis=1)
        total = np.exp(logits - peak[:, None]).sum(axis=1)
        if has_neg and len(owner):
            extra = (q[owner] * neg[0]).sum(axis=1) / temperature
            higher = peak.copy()
            np.maximum.at(higher, owner, extra)
            total = total * np.exp(peak - higher)
            np.add.at(total, owner, np.exp(extra - higher[owner]))
            peak = higher
        return pa.table({"q_idx": table["q_idx"].cast(pa.int64()),
                         "loss": pa.array(np.log(total) + peak - positive)})

    return rows.groupBy("batch").applyInArrow(run, "q_idx bigint, loss double")


def info_nce(rows: DataFrame, temperature: float = 0.05, normalize: bool = False) -> DataFrame:
    return contrastive_terms(rows, temperature, normalize).agg(F.avg("loss").alias("contrastive"))


def norm_mse(df: DataFrame, x: str = "embedding", x_hat: str = "x_hat") -> DataFrame:
    """Mean squared error relative to the variance around the element-wise mean."""
    long = df.select(F.posexplode(F.arrays_zip(F.col(x).alias("x"), F.col(x_hat).alias("y"))).alias("pos", "e"))
    long = long.select("pos", F.col("e.x").cast("double").alias("x"), F.col("e.y").cast("double").alias("y"))
    per_dim = long.groupBy("pos").agg(
        F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("err"),
        F.var_pop("x").alias("var"), F.count(F.lit(1)).alias("n"))
    return per_dim.agg((F.sum("err") / F.sum(F.col("var") * F.col("n"))).alias("norm_mse"))


# ---------------------------------------------------------------- dead features

def dead_features(gaps: DataFrame, threshold: int = 1000) -> np.ndarray:
    """Features of `gaps(feature_id, gap)` inactive for more than `threshold` steps; at most a dictionary's worth."""
    found = gaps.where(F.col("gap") > threshold).select(F.col("feature_id").cast("int")).toArrow()
    return np.unique(found["feature_id"].to_numpy()).astype(np.int64)


def _largest(h: np.ndarray, k: int):
    """k largest entries of each row whatever their sign, ties to the lower column."""
    width = h.shape[1]
    bound = np.partition(h, width - k, axis=1)[:, width - k] - blocks.MARGIN
    rows, cols = np.nonzero(h >= bound[:, None])
    return C.first_of_rows(rows, cols, h[rows, cols], k, len(h))


def auxk_terms(decoded: DataFrame, coder: C.SparseCoder, dead: np.ndarray, auxk_k: int = 512, column: str = "embedding",
               x_hat: str = "x_hat", output: str = "auxk", bound: int | None = None) -> DataFrame:
    """Append how far the strongest dead features are from what the reconstruction `x_hat` leaves over.

    Of the features `dead` the `auxk_k` with the highest pre-activations, negative ones too, are decoded with
    their softplus; the term is the squared distance to the residual, 0 without dead features. Only
    the dead features' weights are shared, by pieces over `bound` bytes; map-only.
    """
    if not len(dead):
        return decoded.withColumn(output, F.lit(0.0))
    part = replace(coder, enc=coder.enc[dead], enc_bias=coder.enc_bias[dead], dec=None if coder.dec is None else coder.dec[dead])
    shared, k = C.share(decoded, part, bound, lambda whole: whole), min(auxk_k, len(dead))
    step = C.row_limit(len(dead))

    def term(x, seen):
        pieces = shared if isinstance(shared, C.Shards) else [(0, shared.value)]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for first, piece in pieces:
            rows, cols, values = _largest(piece.pre_activations(x), min(k, piece.dict_size))
            best = C.first_of_rows(*(np.concatenate(f) for f in zip(best, (rows, cols + first, values))), k, len(x))
        rows, cols, values = best
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(x)))])
        decode = shared.reconstruct if isinstance(shared, C.Shards) else shared.value.reconstruct
        gap = decode(offsets, cols, np.logaddexp(0, values)) - (x - seen)
        return (gap * gap).sum(axis=1)

    names = [*decoded.columns, output]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = batch.slice(start, step)
                value = term(blocks.list_matrix(rows.column(column)), blocks.list_matrix(rows.column(x_hat)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(value)], names=names)

    from pyspark.sql.types import DoubleType, StructField, StructType
    return decoded.mapInArrow(run, StructType([*decoded.schema.fields, StructField(output, DoubleType())]))


def auxk_loss(dense: DataFrame, coder: C.SparseCoder, dead: np.ndarray, auxk_k: int = 512, k: int | None = None,
              column: str = "embedding", bound: int | None = None) -> DataFrame:
    """Mean of `auxk_terms` over all vectors; 0 without dead features."""
    if not len(dead):
        return dense.agg(F.lit(0.0).alias("auxk"))
    return auxk_terms(C.forward(dense, coder, k, column, bound), coder, dead, auxk_k, column, bound=bound).agg(F.avg("auxk").alias("auxk"))


# ---------------------------------------------------------------- combined objectives

# Weights of the objectives, and temperature of the contrastive one.
ALPHA_ALIGN, ALPHA_AUXK, TEMPERATURE = 0.3, 1 / 32, 0.05
CONTRASTIVE = {"paired": 0.0, "retrieval": 0.05}
STAGE3_RECON, STAGE3_DISTILL = 0.1, 0.05


def combined_losses(pairs: DataFrame, coder: C.SparseCoder, cache: str = "retrieval", stage: int = 2, dead: np.ndarray | None = None,
                    k: int | None = None, batch_size: int = 512, seed: int = 0, alpha_align: float = ALPHA_ALIGN,
                    alpha_auxk: float = ALPHA_AUXK, contrastive: float | None = None, auxk_k: int = 512,
                    bound: int | None = None) -> DataFrame:
    """One row of the objectives over `pairs(row_idx, q_emb, p_emb)` and their weighted `total`.

    Stage 2 adds reconstruction, alignment ("paired") or distillation ("retrieval"), dead features and a share of
    the contrastive objective; stage 3 the contrastive one, a tenth of reconstruction and, for "retrieval", a
    twentieth of distillation. An encoder without decoder has neither reconstruction nor dead features, and
    always distils in stage 2. Both sides are coded in one map-only pass, whose terms are stored once for the means and the batches.
    """
    if cache not in CONTRASTIVE or stage not in (2, 3):
        raise ValueError(f"unknown regime {cache!r}, stage {stage!r}")
    rows, decodes = pairs.select("row_idx", "q_emb", "p_emb"), coder.model_type == "sae"
    dead = np.zeros(0, np.int64) if dead is None or stage == 3 or not decodes else dead
    for side in "qp":
        emb, code, hat, aux = (f"{side}_{name}" for name in ("emb", "code", "hat", "aux"))
        if decodes:
            rows = C.forward(rows, coder, k, emb, bound).withColumnsRenamed({"code": code, "x_hat": hat}).drop("active_dims", "positive_pre")
            rows = auxk_terms(rows, coder, dead, auxk_k, emb, hat, aux, bound).withColumn(
                f"{side}_recon", F.lit(1.0) - V.cosine(emb, hat)).drop(hat)
        else:
            rows = C.encode(rows, coder, k, emb, code, bound).withColumns({aux: F.lit(0.0), f"{side}_recon": F.lit(0.0)})
    gap = V.sparse_dot("q_code", "p_code") - V.dot("q_emb", "p_emb")
    terms = cut_lineage(rows.select(
        "row_idx", F.col("q_code").alias("q"), F.col("p_code").alias("p"), ((F.col("q_recon") + F.col("p_recon")) / 2).alias("recon"),
        ((F.col("q_aux") + F.col("p_aux")) / 2).alias("auxk"), align_term("q_code", "p_code").alias("align"), (gap * gap).alias("distill")))
    batches = assign_batches(terms.select(F.col("row_idx").alias("q_idx"), "q", "p"), "q_idx", terms.count(), batch_size, seed)
    means = terms.agg(*[F.avg(c).alias(c) for c in ("recon", "align", "distill", "auxk")])
    means = means.withColumn("contrastive", info_nce(batches, TEMPERATURE).scalar())
    if stage == 3:
        total = F.col("contrastive") + STAGE3_RECON * F.col("recon")
        total = total + STAGE3_DISTILL * F.col("distill") if cache == "retrieval" else total
    else:
        pulled = "align" if cache == "paired" and decodes else "distill"
        share = CONTRASTIVE[cache] if contrastive is None else contrastive
        total = F.col("recon") + alpha_align * F.col(pulled) + alpha_auxk * F.col("auxk") + share * F.col("contrastive")
    return means.withColumn("total", total)


# ---------------------------------------------------------------- schedules

def first_k(dict_size: int, k_final: int) -> int:
    """Where annealing starts: twice the final k and 256 at least, within a quarter of the dictionary."""
    return max(k_final, min(max(256, 2 * k_final), max(1, dict_size // 4)))


def annealed_k(step: Column, steps: int, k_initial: int, k_final: int, schedule: str = "linear") -> Column:
    """k at a training step: from `k_initial` down to `k_final`, which holds from `steps` on; halves go to the even k."""
    done = step / F.lit(float(max(1, steps)))
    if schedule == "linear":
        k = k_initial + (k_final - k_initial) * done
    elif schedule == "cosine":
        k = k_final + (k_initial - k_final) * 0.5 * (1 + F.cos(math.pi * done))
    else:
        raise ValueError(f"unknown schedule {schedule!r}")
    return F.when(step >= steps, F.lit(k_final)).otherwise(F.greatest(F.lit(k_final), F.bround(k).cast("int")))


def learning_rate_share(step: Column, steps: int, warmup: int = 1000) -> Column:
    """Share of the learning rate at a step: a linear rise, then a cosine down to 0 at `steps`."""
    done = (step - warmup) / F.lit(float(max(1, steps - warmup)))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(0.5 * (1 + F.cos(math.pi * done)))
