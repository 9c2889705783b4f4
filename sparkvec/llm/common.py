"""Helpers that several operators share: memory-bounded text batches, ordered shards, counts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.session import ensure_checkpoint_dir, shuffle_partitions

# Bytes of text that one step of an Arrow function holds at a time, beside its longest text.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def store(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared checkpoint folder, so that lost executors cost no replay."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/sparkvec-llm-{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widen(scan: DataFrame) -> DataFrame:
    """A scan of one or a few unsplittable files, dealt out so that every core has work.

    A table in several partitions stays where it is: its texts aren't shuffled.
    """
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism) if scan.rdd.getNumPartitions() < 3 else scan


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of `batch` whose texts hold about `limit` bytes; a longer text gets a range of its own."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def release() -> None:
    """Give memory that this worker has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, whose worker keeps neither what the task before it freed nor what it frees itself: workers are used again,
    and one that waits counts in the executor's memory like one that works."""
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()
    return released


def map_texts(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Apply `fn` to slices of `df` of about `limit` bytes; one task never holds more than a slice and an Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield fn(part)
    return df.mapInArrow(releasing(run), schema)


def small_batches(spark: SparkSession, limit: int = 16 << 20) -> None:
    """Bound the Arrow batches of this session by bytes, so that 10,000 long texts never form one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def shard_bounds(keys: DataFrame, key: str, shards: int) -> list[int]:
    """At most `shards - 1` ascending keys that cut the table into shards of about equal row counts."""
    found = keys.approxQuantile(key, [i / shards for i in range(1, shards)], 0.2 / shards) if shards > 1 else []
    return sorted({int(x) for x in found})


def shard_of(key: str, bounds: list[int]) -> Column:
    """Number of bounds at or below the key: rows of a lower shard have lower keys. Nulls fall in shard 0."""
    if not bounds:
        return F.lit(0)
    above = F.array_size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b <= F.col(key)))
    return F.coalesce(above, F.lit(0)).cast("int")


def shard_count(spark: SparkSession) -> int:
    return max(1, shuffle_partitions(spark))
