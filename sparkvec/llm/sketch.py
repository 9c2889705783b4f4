"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash space. Which hashes are
kept depends on the hash alone, so sketches of any two texts can be compared, however unequal they are:
intersections and unions of sketches are samples of those of the shingle sets, and the sketch of a union
is the union of the sketches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, shard_bounds, shard_count, shard_of, slices, small_batches, text_of, texts, widen
from .simhash import shingle_hashes

WORDS = 5
# One in 2**SHIFT hashes is kept.
SHIFT = 2
# Bits of a kept hash that the printed form holds, next to those that the threshold fixes.
KEPT_BITS = 40


def sketch(text: str, words: int = WORDS, shift: int = SHIFT) -> np.ndarray:
    """Sorted distinct values of the kept hashes.

    A text whose hashes all lie above the threshold keeps its smallest one, marked by the top bit, so that
    only a text without words has an empty sketch.
    """
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return hashes
    kept = hashes[hashes < np.uint64(1 << (64 - shift))] if shift else hashes
    if not len(kept):
        return np.array([hashes.min() | np.uint64(1 << 63)], np.uint64)
    return np.unique(kept >> np.uint64(64 - shift - KEPT_BITS))


def encode(values: np.ndarray) -> str:
    """Printed form: five bytes a value in base 64; a lone smallest hash in hexadecimal after a tilde."""
    if len(values) == 1 and int(values[0]) >> 63:
        return f"~{int(values[0]):016x}"
    return base64.b64encode(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()).decode()


def decode(printed: str) -> np.ndarray:
    if printed.startswith("~"):
        return np.array([int(printed[1:], 16)], np.uint64)
    raw = np.frombuffer(base64.b64decode(printed), np.uint8).reshape(-1, 5)
    return np.concatenate([np.zeros((len(raw), 3), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the two texts' shingles together; a lone smallest hash gives way to any kept one."""
    both = np.union1d(a, b)
    kept = both[both < np.uint64(1 << 63)]
    return kept if len(kept) else both[:1]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingle sets: 1 for two texts without words."""
    if not len(a) and not len(b):
        return 1.0
    shared = _shared(a, b)
    return shared / (len(a) + len(b) - shared)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has: 1 if a has none."""
    return _shared(a, b) / len(a) if len(a) else 1.0


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, shift: int = SHIFT) -> DataFrame:
    """`id_col`, n_chars, fingerprint of every row, map-only. Null texts are empty; repeated rows repeat."""
    small_batches(docs.sparkSession)
    rows = widen(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).withColumn("text", text_of())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = texts(batch, "text")
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(t) for t in items], pa.int64()),
             pa.array([encode(sketch(t, words, shift)) for t in items], pa.string())], [id_col, "n_chars", "fingerprint"])
    return map_texts(rows, "text", run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_chars bigint, fingerprint string")


def in_order_with_next(docs: DataFrame, id_col: str, text_col: str, shards: int | None = None) -> DataFrame:
    """Rows (id, text, ahead) sorted by id within shards, each shard followed by the first row of the next.

    Texts are shuffled once. The first id of each shard is the only thing that the driver gathers: at most
    one per shard. The shard behind the last one is the first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or shard_count(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).withColumn("text", text_of())
    bounds = shard_bounds(rows.select("id"), "id", shards)
    placed = rows.withColumn("shard", shard_of("id", bounds))
    first = F.when(F.count(F.lit(1)) == F.count("id"), F.min("id"))  # a null id comes first
    heads = sorted(tuple(r) for r in placed.groupBy("shard").agg(first.alias("head")).collect())
    follow = [(heads[k][1], heads[k - 1][0]) for k in range(len(heads))]
    heads_table = spark.createDataFrame(follow, "head bigint, into int")
    met = placed.join(F.broadcast(heads_table), placed["id"].eqNullSafe(F.col("head")), "left")
    here, ahead = F.struct(F.col("shard"), F.lit(0).alias("ahead")), F.struct(F.col("into").alias("shard"), F.lit(1).alias("ahead"))
    copies = met.select("id", "text", F.explode(F.when(F.col("into").isNull(), F.array(here)).otherwise(F.array(here, ahead))).alias("at"))
    return (copies.select("id", "text", "at.shard", "at.ahead").repartitionById(len(bounds) + 1, "shard")
            .sortWithinPartitions("shard", "ahead", F.col("id").asc_nulls_first(), "text"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       shift: int = SHIFT, shards: int | None = None) -> DataFrame:
    """Fingerprints of every text and of an edited form of it, and their likeness.

    The edited text has its last floor(n/4) code points replaced by as many first ones, or all, of the next
    document by ascending id (after the last: the first). Returns `id_col`, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, edited_containment, next_containment.
    Null texts are empty; rows without an id come first; rows that repeat an id follow by text. A
    table of one row is its own next. Memory: a slice of texts and one text behind it.
    """
    rows = in_order_with_next(docs, id_col, text_col, shards)
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "edited_containment", "next_containment"]
    types = ["bigint", "string", "string", "string", "double", "double", "double", "double"]

    def row(doc, text, mine, after, following):
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        changed = sketch(edited, words, shift)
        return (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), encode(mine), encode(changed),
                likeness(mine, changed), likeness(mine, following), containment(mine, changed), containment(mine, following))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, None
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc, text, shard, ahead in zip(part.column("id").to_pylist(), texts(part, "text"),
                                                   part.column("shard").to_pylist(), part.column("ahead").to_pylist()):
                    if ahead and done == shard:
                        continue  # further rows that repeat the next shard's first id
                    mine = sketch(text, words, shift)
                    if last is not None:
                        out.append(row(*last, text, mine))
                    last, done = (None, shard) if ahead else ((doc, text, mine), None)
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *map(pa.array, columns[1:])], [id_col, *names])
    return rows.mapInArrow(run, f"{id_col} bigint, " + ", ".join(f"{n} {t}" for n, t in zip(names, types)))
