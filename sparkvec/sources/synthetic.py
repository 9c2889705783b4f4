"""Correlated vector pairs for tests and demonstrations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.hashing import hash_int


def normal_noise(seed: int, row: str, side: int, dim: int) -> Column:
    """`dim` normal draws of a row, as long as a unit vector on average.

    Two seeded hashes a component give its radius and angle, so any engine can repeat them.
    """
    def uniform(i: Column, part: str) -> Column:
        return (hash_int(seed, F.col(row), F.lit(side), i, F.lit(part)) + F.lit(0.5)) / F.lit(float(1 << 60))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.sqrt(-2 * F.log(uniform(i, "r"))) * F.cos(
        2 * math.pi * uniform(i, "a")) / F.lit(math.sqrt(dim)))


def correlated_pairs(rows: DataFrame, dim: int, r: float = 0.7, seed: int = 42,
                     shared: str | None = None) -> DataFrame:
    """Pairs `r*shared + (1-r)*noise`, L2-normalised, for every `row_idx` of `rows`.

    `shared` names a vector column; without it the common part is drawn too. A row is
    seeded by its own index, so partitioning cannot change its values.
    """
    if not 0 <= r <= 1:
        raise ValueError("r must be between 0 and 1")
    common = F.transform(shared, lambda x: x.cast("double")) if shared else normal_noise(seed, "row_idx", 0, dim)
    drawn = rows.select("row_idx", common.alias("c"), *[normal_noise(seed, "row_idx", s, dim).alias(f"n{s}") for s in (1, 2)])
    mixed = drawn.select("row_idx", *[F.zip_with("c", f"n{s}", lambda c, n: r * c + (1 - r) * n).alias(f"v{s}") for s in (1, 2)])
    return mixed.select("row_idx", *[V.l2_normalize(f"v{s}", "add").cast("array<float>").alias(name)
                                     for s, name in ((1, "image_emb"), (2, "text_emb"))])


def synthetic_pairs(spark: SparkSession, n: int, dim: int, r: float = 0.7, seed: int = 42) -> DataFrame:
    return correlated_pairs(spark.range(n).withColumnRenamed("id", "row_idx"), dim, r, seed)


def mean_paired_cosine(pairs: DataFrame, first: int | None = None) -> DataFrame:
    """Over all pairs, or over the `first` ones on request."""
    return (pairs if first is None else pairs.where(F.col("row_idx") < first)).agg(
        F.avg(V.cosine("image_emb", "text_emb")).alias("mean_cosine"))
