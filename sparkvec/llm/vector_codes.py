"""Vector code compression: product codes whose codebooks are trained by Lloyd rounds over resident members.

A vector is cut into equal parts; each position has a codebook of a few entries, and the vector's code is
the nearest entry of each part. For training, the parts live as rows in partitions of (position, entry,
salt). A round sums every owner's resident members, which leaves a few rows per owner to combine, and then
assigns the members where they lie; only the parts whose entry changed go through the next shuffle.
Everything is integer arithmetic, so results don't depend on partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvec.session import shuffle_partitions

from .common import store, widen

SCALE = 256
# Rows of the table of errors by label that are broadcast; a longer table is joined by shuffle.
LABELS_BROADCAST = 500_000
# Members of one position that a salt is meant for, were they spread evenly over the entries.
SALT_ROWS = 4_000_000
_STEP = 1 << 22


def is_whole(vector: str) -> Column:
    """The vector is there and all its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def integers(column: pa.Array, parts: int, length: int = 0) -> np.ndarray:
    """floor(256 * x) of whole vectors, one row each; all must have one length, a multiple of `parts`."""
    lengths = np.unique(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(lengths) > 1 or lengths[0] == 0 or lengths[0] % parts or lengths[0] != (length or lengths[0]):
        raise ValueError(f"vectors must have one length, a multiple of {parts}: found {lengths.tolist()[:5]}, expected {length or 'any'}")
    flat = np.floor(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64) * SCALE)
    most = float(np.abs(flat).max())
    if int(lengths[0]) // parts * (2 * most) ** 2 >= 2.0 ** 62:
        raise ValueError(f"components up to {most / SCALE:g} are too large for exact 64-bit distances")
    return flat.astype(np.int64).reshape(len(column), -1)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest index of the nearest entry and the squared distance, for each row; exact.

    Doubles hold the products exactly while every term stays below 2^53; larger components use 64-bit integers.
    """
    size = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * size * size * max(1, points.shape[1]) < 1 << 53 else np.int64
    b = book.astype(kind)
    norms = (b * b).sum(axis=1)
    index, least = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
    step = max(1, _STEP // len(book))
    for at in range(0, len(points), step):
        p = points[at:at + step].astype(kind)
        d = norms - 2 * (p @ b.T)
        k = d.argmin(axis=1)
        index[at:at + step] = k
        least[at:at + step] = (d[np.arange(len(p)), k] + (p * p).sum(axis=1)).astype(np.int64)
    return index, least


def _members(pos, entry, salt, parts, n, extra=()) -> pa.RecordBatch:
    ends = np.arange(len(parts) + 1, dtype=np.int32) * parts.shape[1]
    columns = [pa.array(pos, pa.int32()), pa.array(entry, pa.int32()), pa.array(salt, pa.int32()),
               pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(parts).ravel(), pa.int64())), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(e, pa.int32()) for _, e in extra)],
                                      ["pos", "entry", "salt", "part", "n", *(name for name, _ in extra)])


MEMBER = "pos int, entry int, salt int, part array<bigint>, n bigint"


def deal(vectors: DataFrame, books: np.ndarray, vec_col: str, salts: int) -> DataFrame:
    """The parts of all vectors as members of their first entries, stored at their owners.

    Equal parts of one Arrow batch become one member with a count, so that copies of a vector cost
    one row per batch; salts are dealt by turns.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = integers(batch.column(0), len(books), len(books) * books.shape[2])
            width = whole.shape[1] // len(books)
            for pos, book in enumerate(books):
                parts, n = np.unique(whole[:, pos * width:(pos + 1) * width], axis=0, return_counts=True)
                rows = np.arange(len(parts))
                yield _members(np.full(len(parts), pos), nearest(parts, book)[0], rows % salts, parts, n)
    dealt = vectors.select(vec_col).mapInArrow(run, MEMBER)
    return store(at_owners(dealt), "members")


def at_owners(members: DataFrame) -> DataFrame:
    return members.repartition(shuffle_partitions(members.sparkSession), "pos", "entry", "salt")


def migrate(members: DataFrame, books: np.ndarray) -> DataFrame:
    """Members under new codebooks: assigned where they lie and stored there; only those with another entry move."""
    shared = members.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, entry, salt, n = (batch.column(k).to_numpy() for k in (0, 1, 2, 4))
            parts = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            goal = np.empty(len(pos), np.int32)
            for p in np.unique(pos).tolist():
                here = pos == p
                goal[here] = nearest(parts[here], shared.value[p])[0]
            yield _members(pos, entry, salt, parts, n, [("goal", goal)])
    assigned = store(members.mapInArrow(run, MEMBER + ", goal int"), "assigned")
    moved = assigned.select("pos", F.col("goal").alias("entry"), "salt", "part", "n")
    return moved.where(assigned["entry"] == assigned["goal"]).unionByName(at_owners(moved.where(assigned["entry"] != assigned["goal"])))


def update(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each entry's members; an entry without members stays."""
    width = books.shape[2]
    sums = members.groupBy("pos", "entry").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.col("part")[i] * F.col("n")) for i in range(width))).alias("sums"))
    new = books.copy()
    for row in sums.collect():  # at most one row per codebook entry
        new[row["pos"], row["entry"]] = [s // row["n"] for s in row["sums"]]
    return new


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id",
          vec_col: str = "embedding", salts: int | None = None) -> np.ndarray:
    """Codebooks (parts, entries, width) as integers after `rounds` rounds over all whole vectors.

    They start as the parts of the `entries` smallest ids, rows without an id last, rows of one id by their
    vectors; with fewer whole vectors there are fewer entries, with none there is none. Differing lengths,
    or lengths that aren't a multiple of `parts`, are a ValueError.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code digit pair holds 1 to 256 entries")
    kept = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].alias("v")).where(is_whole("v"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return np.empty((parts, 0, 0), np.int64)
    whole = integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), parts)
    books = np.ascontiguousarray(whole.reshape(len(first), parts, -1).transpose(1, 0, 2))
    salts = salts or 4 + vectors.count() // (SALT_ROWS * entries)
    members = None
    for _ in range(rounds):
        members = deal(widen(kept.select("v")), books, "v", salts) if members is None else migrate(members, books)
        books = update(members, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """`id_col`, code (two hex digits per part), error (summed squared distance) and the columns `keep` of every
    whole vector; the others are dropped. Map-only."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    chosen = vectors.select(vectors[vec_col].alias("v"), *(vectors[c].alias(f"c{k}") for k, c in enumerate((id_col, *keep)))).where(is_whole("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = integers(batch.column(0), len(books), len(books) * books.shape[2])
            width = whole.shape[1] // len(books)
            found = [nearest(whole[:, p * width:(p + 1) * width], book) for p, book in enumerate(books)]
            digits = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
            size = 2 * len(books)
            codes = [digits[i:i + size] for i in range(0, len(digits), size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(codes), pa.array(sum(f[1] for f in found), pa.int64())],
                                             [*batch.schema.names[1:], "code", "error"])
    kinds = [vectors.schema[c].dataType.simpleString() for c in (id_col, *keep)]
    schema = ", ".join(f"c{k} {kind}" for k, kind in enumerate(kinds)) + ", code string, error bigint"
    made = widen(chosen).mapInArrow(run, schema)
    return made.select(F.col("c0").alias(id_col), "code", "error", *(F.col(f"c{k}").alias(c) for k, c in enumerate(keep, 1)))


def decode(coded: DataFrame, books: np.ndarray, column: str = "code") -> DataFrame:
    """`coded` with `vector`: the entries that its code names, divided by 256. A null code gives null."""
    flat = F.lit((books / SCALE).reshape(-1).tolist()) if books.size else F.array().cast("array<double>")
    n, width = books.shape[1:]
    entry = lambda p: F.conv(F.substr(column, F.lit(2 * p + 1), F.lit(2)), 16, 10).cast("int") + p * n
    parts = [F.slice(flat, entry(p) * width + 1, F.lit(width)) for p in range(len(books))]
    return coded.withColumn("vector", F.when(F.col(column).isNotNull(), F.concat(*parts)))


def fingerprint(books: np.ndarray) -> str:
    """sha256 of all components as decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id",
             vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """`id_col`, code, error, label_error and codebooks_sha256 of every whole vector.

    label_error sums the error over the rows of one label; rows without a label are one group. Repeated
    rows repeat; other columns are never read; an empty table gives an empty result.
    """
    books = train(vectors, parts, entries, rounds, id_col, vec_col)
    if not books.size:
        none = vectors.where("false")
        return none.select(none[id_col], F.lit("").alias("code"), *(F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")),
                           F.lit("").alias("codebooks_sha256"))
    coded = store(encode(vectors.select(vectors[id_col].alias("id"), vectors[vec_col].alias("v"), vectors[label_col].alias("label")),
                         books, "id", "v", ("label",)), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    small = sums.limit(LABELS_BROADCAST + 1).count() <= LABELS_BROADCAST
    sums = sums.withColumnRenamed("label", "_label")
    joined = coded.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
