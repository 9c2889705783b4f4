"""Dense vector datasets: Parquet with a manifest, and headerless float32 files."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import path_exists, remove

CACHE_VERSION = 2
DIGEST_RANGE = 1 << 20           # rows per digest above that
SPLIT_BYTES = 64 * 1024 * 1024


# ---------------------------------------------------------------- raw float32 source

class RowRange(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class DenseCacheReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.matrices = [m.split("=") for m in options["matrices"].split(",")]
        self.count, self.dim = int(options["count"]), int(options["dim"])
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self):
        step = max(1, self.split_bytes // (self.dim * 4 * len(self.matrices)))
        return [RowRange(a, min(a + step, self.count)) for a in range(0, self.count, step)] or [RowRange(0, 0)]

    def read(self, partition):
        import pyarrow.fs as pafs
        base = self.path if "://" in self.path else os.path.abspath(self.path)
        fs, root = pafs.FileSystem.from_uri(base)
        step = max(1, (8 << 20) // (self.dim * 4))
        files = [fs.open_input_file(f"{root.rstrip('/')}/{name}") for _, name in self.matrices]
        for a in range(partition.start, partition.stop, step):
            b = min(a + step, partition.stop)
            columns = [pa.array(np.arange(a, b, dtype=np.int64))]
            for f in files:
                data = f.read_at((b - a) * self.dim * 4, a * self.dim * 4)
                if len(data) != (b - a) * self.dim * 4:
                    raise ValueError(f"{self.path}: file is shorter than {self.count} rows")
                offsets = np.arange(b - a + 1, dtype=np.int32) * self.dim
                columns.append(pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.frombuffer(data, np.float32))))
            yield pa.RecordBatch.from_arrays(columns, names=["row_idx"] + [c for c, _ in self.matrices])


class DenseCache(DataSource):
    """Row-major float32 matrices without header, split by row range.

    Options: path, matrices ("column=file,..."), count, dim. Rows after `count` are
    unused preallocated space and are not read.
    """

    @classmethod
    def name(cls):
        return "densecache"

    def schema(self):
        columns = [m.split("=")[0] for m in self.options["matrices"].split(",")]
        return ", ".join(["row_idx bigint"] + [f"{c} array<float>" for c in columns])

    def reader(self, schema):
        return DenseCacheReader(self.options)


def _read_matrices(spark: SparkSession, path: str, matrices: dict[str, str], count: int, dim: int,
                   split_bytes: int) -> DataFrame:
    spark.dataSource.register(DenseCache)
    return (spark.read.format("densecache")
            .option("matrices", ",".join(f"{c}={f}" for c, f in matrices.items()))
            .option("count", count).option("dim", dim).option("splitbytes", split_bytes).load(path))


def _sidecar(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.option("wholetext", "true").text(path).first()["value"])


def read_raw_ids(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The ordered id list: one JSON array, which is all a reader of that format can split."""
    ids = spark.read.option("wholetext", "true").text(f"{path}/{kind}_ids.json")
    return ids.select(F.posexplode(F.from_json("value", "array<string>")).alias("row_idx", "item_id")).select(
        F.col("row_idx").cast("bigint").alias("row_idx"), "item_id")


def read_raw_dense(spark: SparkSession, path: str, kind: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """`kind, row_idx, item_id, embedding` of a raw cache directory."""
    meta = _sidecar(spark, f"{path}/{kind}_meta.json")
    vectors = _read_matrices(spark, path, {"embedding": f"{kind}_embeddings.npy"},
                             int(meta["count"]), int(meta["embedding_dim"]), split_bytes)
    return vectors.join(read_raw_ids(spark, path, kind), "row_idx").select(
        F.lit(kind).alias("kind"), "row_idx", "item_id", "embedding")


def read_pairs(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """`row_idx, image_emb, text_emb`; both files are read by row range in the same task, without a join."""
    meta = _sidecar(spark, f"{path}/metadata.json")
    return _read_matrices(
        spark, path, {"image_emb": "image_embeddings.npy", "text_emb": "text_embeddings.npy"},
        int(meta["num_samples"]), int(meta["embedding_dim"]), split_bytes)


def write_raw_matrix(df: DataFrame, column: str, file: str, count: int, dim: int,
                     spare_rows: int = 0) -> int:
    """Write `df(row_idx, column)` as a raw float32 file on a shared mount.

    Every task writes its rows at their own offsets, so a repeated task writes the same
    bytes again. Returns the number of rows written.
    """
    with open(file, "wb") as f:
        f.truncate((count + spare_rows) * dim * 4)

    def run(batches):
        fd = os.open(file, os.O_WRONLY)
        try:
            for batch in batches:
                rows = batch.column(0).to_numpy()
                values = np.ascontiguousarray(
                    batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float32)
                if len(values) != len(rows) * dim:
                    raise ValueError(f"vectors are not of dimension {dim}")
                for i, row in enumerate(rows.tolist()):
                    os.pwrite(fd, values[i * dim:(i + 1) * dim].tobytes(), row * dim * 4)
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])
            os.fsync(fd)
        finally:
            os.close(fd)

    # sorted row ranges make each task's writes contiguous
    ordered = df.select("row_idx", column).repartitionByRange("row_idx").sortWithinPartitions("row_idx")
    return int(ordered.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


# ---------------------------------------------------------------- manifest

def id_digest(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids in row order joined by newlines, as one row `id_sha256`."""
    entries = F.array_sort(F.collect_list(F.struct("row_idx", "item_id")))
    return rows.agg(F.sha2(F.array_join(F.transform(entries, lambda x: x["item_id"]), "\n"), 256).alias("id_sha256"))


def ranged_digest(rows: DataFrame) -> DataFrame:
    """Digest of the per-range digests: no task ever holds more than one range of ids."""
    part = (F.col("row_idx") / F.lit(DIGEST_RANGE)).cast("bigint")
    entries = F.array_sort(F.collect_list(F.struct("row_idx", "item_id")))
    ranges = rows.groupBy(part.alias("row_idx")).agg(F.sha2(F.array_join(
        F.transform(entries, lambda x: x["item_id"]), "\n"), 256).alias("item_id"))
    return id_digest(ranges)


def manifest(rows: DataFrame, digest: str = "ranged", **context) -> DataFrame:
    """One row describing `rows(row_idx, item_id, embedding)`; context fields are carried as given.

    The Parquet cache has the ranged digest and version 3 at every size. "joined" gives the digest and
    version of raw caches, for which one task reads all ids.
    """
    if digest not in ("ranged", "joined"):
        raise ValueError(f"unknown digest {digest!r}")
    made = ranged_digest(rows) if digest == "ranged" else id_digest(rows)
    facts = rows.agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("embedding_dim"),
        F.min_by("item_id", "row_idx").alias("first_id"), F.max_by("item_id", "row_idx").alias("last_id"))
    return facts.select(
        F.lit(CACHE_VERSION + 1 if digest == "ranged" else CACHE_VERSION).alias("cache_version"),
        *[F.lit(context.get(name, default)).alias(name) for name, default in (
            ("model_name", ""), ("batch_size", 0), ("system_instruction", ""),
            ("text_prefix", ""), ("kind", ""))],
        "count", "embedding_dim", made.scalar().alias("id_sha256"), "first_id", "last_id")


def complete_legacy(meta: dict, rows: DataFrame | None, digest: str = "joined") -> dict:
    """Fill the fields an older manifest lacks; the digest and end ids come from the data."""
    out = dict(meta)
    if "system_instruction" not in out and "instruction" in out:
        out["system_instruction"] = out["instruction"]
    out.setdefault("text_prefix", "")
    out.setdefault("cache_version", CACHE_VERSION + 1 if digest == "ranged" else CACHE_VERSION)
    if rows is not None and any(f not in out for f in ("id_sha256", "first_id", "last_id")):
        facts = manifest(rows, digest).first()
        for f in ("id_sha256", "first_id", "last_id"):
            out.setdefault(f, facts[f])
    return out


def mismatches(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """`field, expected, actual` where two one-row frames disagree; a null expectation is no expectation."""
    def fields(df, value):
        text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        return text.unpivot([], text.columns, "field", value)

    return fields(expected, "expected").join(fields(actual, "actual"), "field", "full").where(
        F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("actual")))


# ---------------------------------------------------------------- Parquet cache

def write_dense(df: DataFrame, path: str, kind: str, expected_ids: DataFrame | None = None, **context) -> DataFrame:
    """Write `df(row_idx, item_id, embedding)` and, once verified, its manifest.

    The manifest is the commit mark: an old one goes before the vectors are touched, the new one
    is written last, and only if the stored ids are exactly the expected ones.
    """
    spark = df.sparkSession
    remove(spark, f"{path}/manifest/kind={kind}")
    target = f"{path}/vectors/kind={kind}"
    df.select("row_idx", "item_id", "embedding").write.mode("overwrite").parquet(target)
    stored = spark.read.parquet(target)
    if expected_ids is not None:
        wrong = stored.select("row_idx", "item_id").join(
            expected_ids.select("row_idx", F.col("item_id").alias("want")), "row_idx", "full").where(
            ~F.col("item_id").eqNullSafe(F.col("want"))).limit(1).count()
        if wrong:
            raise ValueError(f"{kind}: stored ids differ from the expected ids")
    facts = manifest(stored, kind=kind, **context)
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/kind={kind}")
    return facts


def read_dense(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema("row_idx bigint, item_id string, embedding array<float>").parquet(
        f"{path}/vectors/kind={kind}").select(F.lit(kind).alias("kind"), "row_idx", "item_id", "embedding")


MANIFEST_SCHEMA = ("cache_version int, model_name string, batch_size int, system_instruction string, "
                   "text_prefix string, kind string, count bigint, embedding_dim int, id_sha256 string, "
                   "first_id string, last_id string")


def validate_cache(spark: SparkSession, path: str, kind: str, expected: dict) -> DataFrame:
    """Reasons why the cache does not fit; no rows means valid."""
    for part in ("vectors", "manifest"):
        if not path_exists(spark, f"{path}/{part}/kind={kind}"):
            return spark.createDataFrame([("missing files", part, None)],
                                         "field string, expected string, actual string")
    meta = spark.read.schema(f"{MANIFEST_SCHEMA}, instruction string").json(f"{path}/manifest/kind={kind}").drop("kind").first()
    meta = {k: v for k, v in (meta.asDict() if meta else {}).items() if v is not None}
    stored = read_dense(spark, path, kind)
    count = stored.count()
    meta = complete_legacy(meta, stored, "ranged")
    if meta.setdefault("count", count) != count:
        return spark.createDataFrame([("stored rows", str(meta["count"]), str(count))],
                                     "field string, expected string, actual string")
    names = [p.split()[0] for p in MANIFEST_SCHEMA.split(", ")]
    actual = spark.createDataFrame([tuple({**meta, "kind": kind}.get(n) for n in names)], MANIFEST_SCHEMA)
    wanted = spark.createDataFrame(
        [tuple(None if v is None else str(v) for v in expected.values())],
        ", ".join(f"{k} string" for k in expected))
    return mismatches(actual, wanted)


def embed_cached(items: DataFrame, factory, path: str, kind: str, expected: dict,
                 overwrite: bool = False, skip_validation: bool = False, **options) -> DataFrame:
    """Reuse the cache when its manifest fits, else embed and write it."""
    from ..operators.embed import embed
    if overwrite and skip_validation:
        raise ValueError("overwrite and skip_validation exclude each other")
    spark = items.sparkSession
    if skip_validation:
        return read_dense(spark, path, kind)
    if overwrite or not validate_cache(spark, path, kind, expected).isEmpty():
        vectors = embed(items, factory, keep=["row_idx", "item_id"], **options)
        context = {k: v for k, v in expected.items()
                   if v is not None and k in ("model_name", "batch_size", "system_instruction", "text_prefix")}
        write_dense(vectors, path, kind, items.select("row_idx", "item_id"), **context)
    return read_dense(spark, path, kind)
