"""Resumable embedding, incremental indexing and activity tracking as streams.

Progress is the stream's checkpoint. Sinks write each micro-batch to a folder named by
its batch id, so a batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vector as V
from ..operators.embed import embed
from ..session import path_exists
from ..sources.dense import mismatches
from ..sources.index_store import compact_index, write_segment


def check_guard(spark: SparkSession, path: str, guard: dict) -> None:
    """Refuse to continue a job that was started with other settings."""
    wanted = spark.createDataFrame(
        [tuple(str(v) for v in guard.values())], ", ".join(f"{k} string" for k in guard))
    if not path_exists(spark, f"{path}/guard"):
        wanted.coalesce(1).write.json(f"{path}/guard")
        return
    stored = spark.read.schema(wanted.schema).json(f"{path}/guard")
    wrong = mismatches(stored, wanted).collect()
    if wrong:
        raise ValueError("cannot resume, settings differ: " + "; ".join(
            f"{r['field']} expected {r['expected']}, found {r['actual']}" for r in wrong))


def embed_stream(items: DataFrame, factory: Callable, path: str, guard: dict,
                 batch_size: int = 256, available_now: bool = True) -> StreamingQuery:
    """Embed a stream of items into `path/vectors`; a finished job has nothing left to do."""
    check_guard(items.sparkSession, path, guard)
    vectors = embed(items, factory, batch_size, on_error="retry_items", keep=["kind", "item_id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/vectors/batch={batch_id}")

    writer = vectors.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_embedded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, item_id string, embedding array<float>").option(
        "recursiveFileLookup", "true").parquet(f"{path}/vectors")


def index_stream(codes: DataFrame, path: str, available_now: bool = True, compact_every: int = 0) -> StreamingQuery:
    """Bring a stream of `codes(doc_idx, code)` into the index stored at `path`.

    A document that comes again replaces its older state, a null code deletes it. With `compact_every` the
    batches are merged into a new base after each so many.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_segment(batch, path, batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact_index(batch.sparkSession, path)

    writer = codes.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def activity_stream(activity: DataFrame) -> DataFrame:
    """Last active step per feature of a stream of `activity(step, feature_id)`.

    A built-in aggregate: partial maxima are taken before the shuffle, and the state
    is one number per feature.
    """
    return activity.groupBy("feature_id").agg(F.max("step").alias("last_step"))


def activity_snapshot(stream: DataFrame, path: str, available_now: bool = True) -> StreamingQuery:
    """Write the features that each micro-batch of `activity(step, feature_id)` touches to a folder of the batch.

    Only touched features are written; a batch that is run again replaces its own folder, and readers never
    find a folder gone.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/activity/batch={batch_id}")

    writer = activity_stream(stream).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_activity(spark: SparkSession, path: str, n_steps: int) -> DataFrame:
    """`feature_id`, last_step and gap as of the last whole batch."""
    rows = spark.read.schema("feature_id bigint, last_step bigint").option("recursiveFileLookup", "true").parquet(f"{path}/activity")
    return rows.groupBy("feature_id").agg(F.max("last_step").alias("last_step")).withColumn(
        "gap", F.lit(n_steps - 1) - F.col("last_step"))


def stream_table(spark: SparkSession, path: str, schema: str, max_files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


CODES_SCHEMA = f"doc_idx bigint, code {V.CODE_TYPE}"
