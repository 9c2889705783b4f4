"""Stored models, rankings and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coding import DenseAE, META_SCHEMA, SparseCoder, StoredCoder, WEIGHTS_SCHEMA, coder_from_frames, vectors_array
from ..operators.coding import stored_coder as coder_of_frames
from .index_store import read_index, write_index  # noqa: F401


def write_weights(coder: SparseCoder, spark: SparkSession, path: str, **provenance) -> None:
    """Weights and a one-row description with its training provenance."""
    weights, meta = coder.to_frames(spark)
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    source = F.struct(*[F.lit(str(v)).alias(k) for k, v in provenance.items()]) if provenance else None
    meta = meta.withColumn("provenance", F.to_json(source) if source is not None else F.lit("{}"))
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_weight_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema(WEIGHTS_SCHEMA).parquet(f"{path}/weights"),
            spark.read.schema(META_SCHEMA + ", provenance string").parquet(f"{path}/meta"))


def read_weights(spark: SparkSession, path: str) -> SparseCoder:
    return coder_from_frames(*read_weight_frames(spark, path))


def stored_coder(spark: SparkSession, path: str) -> StoredCoder:
    """The coder at `path`, applied piece by piece without ever being whole on the driver."""
    return coder_of_frames(*read_weight_frames(spark, path))


LAYERS = "part string, layer int, unit int, w array<float>, b float"


def write_dense_ae(model: DenseAE, spark: SparkSession, path: str) -> None:
    parts = []
    for part, layers in (("enc", model.enc), ("dec", model.dec)):
        for i, (w, b) in enumerate(layers):
            parts.append(pa.table({
                "part": pa.array([part] * len(w)), "layer": pa.array(np.full(len(w), i, np.int32)),
                "unit": pa.array(np.arange(len(w), dtype=np.int32)), "w": vectors_array(w),
                "b": pa.array(b.astype(np.float32))}))
    spark.createDataFrame(pa.concat_tables(parts)).write.mode("overwrite").parquet(f"{path}/layers")
    spark.createDataFrame([(model.normalize,)], "normalize boolean").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/meta")


def read_dense_ae(spark: SparkSession, path: str) -> DenseAE:
    """Linear or mlp follows from the number of stored layers."""
    from ..operators.blocks import list_matrix
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None:
        raise ValueError("model metadata is missing")
    table = spark.read.schema(LAYERS).parquet(f"{path}/layers").orderBy("part", "layer", "unit").toArrow()
    sides: dict[str, list] = {"enc": [], "dec": []}
    import pyarrow.compute as pc
    for part, out in sides.items():
        own = table.filter(pc.equal(table["part"], part))
        for i in range((pc.max(own["layer"]).as_py() or 0) + 1):
            layer = own.filter(pc.equal(own["layer"], i))
            out.append((list_matrix(layer["w"]).astype(np.float32),
                        layer["b"].to_numpy().astype(np.float32)))
    return DenseAE(sides["enc"], sides["dec"], bool(meta["normalize"]))


def write_trec(run: DataFrame, path: str, tag: str, real_score: bool = False) -> None:
    """Run file(s) ordered by query and rank across the part files."""
    from ..operators.metrics import trec_lines
    (trec_lines(run, tag, real_score).repartitionByRange("qid", "rank")
     .sortWithinPartitions("qid", "rank").select("line").write.mode("overwrite").text(path))


def report(metrics_long: DataFrame, timings: DataFrame, primary_k: int | None = None, **context) -> DataFrame:
    """One JSON row: metrics per method and k, the primary k, stage times, context.

    `primary_k` is the first k that was asked for; a method that has no such k is reported under its smallest.

    The input is a summary: a few rows per method and k, whatever the corpus size.
    """
    per_k = metrics_long.groupBy("method", "k").agg(
        F.array_sort(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    methods = per_k.groupBy("method").agg(
        F.array_sort(F.collect_list(F.struct("k", "metrics"))).alias("suite"), F.coalesce(F.max(F.when(F.col("k") == F.lit(primary_k), F.col("k"))), F.min("k")).alias("primary_k"))
    times = timings.groupBy().agg(F.array_sort(
        F.collect_list(F.struct("method", "k", "stage", "seconds"))).alias("timings"))
    body = F.struct(
        F.array_sort(F.collect_list(F.struct("method", "primary_k", "suite"))).alias("methods"),
        times.scalar().alias("timings"),
        F.struct(*[F.lit(v).alias(k) for k, v in context.items()] or [F.lit(None).alias("none")]).alias("context"))
    return methods.groupBy().agg(F.to_json(body).alias("report"))


def write_report(metrics_long: DataFrame, timings: DataFrame, path: str, primary_k: int | None = None, **context) -> None:
    metrics_long.write.mode("overwrite").parquet(f"{path}/metrics")
    timings.write.mode("overwrite").parquet(f"{path}/timings")
    report(metrics_long, timings, primary_k, **context).coalesce(1).write.mode("overwrite").text(f"{path}/report")
