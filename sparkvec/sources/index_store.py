"""A stored sparse index that takes updates.

The index is a base and later segments, each a folder of codes by document and one of postings. A segment
holds the documents of one batch: its rows replace those of older ones, and a row without a code deletes
its document. A segment or base counts once its entry in `log` is there, which is written last, so a
reader never sees half of one, and a batch that is run again replaces itself. Compaction writes a new base up
to a version and then its log entry; until that entry is there, readers keep the older base and all segments.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators.search import SparseIndex, bounds_of, doc_stats_of, one_decimal, postings_of
from ..session import child_names, remove, touch

INDEX_DOCS = f"doc_idx bigint, code {V.CODE_TYPE}"
POSTINGS = "feature_id int, doc_idx bigint, weight float, doc_norm double"
STATS = "feature_id int, n bigint"
BOUNDS = "feature_id int, block bigint, top double, low double, top_share double, low_share double"
# Documents of later segments whose ids are broadcast (8 bytes each); more of them meet the base by shuffle.
TOUCHED_BROADCAST = 4_000_000


def _write(index: SparseIndex, path: str, name: str) -> None:
    """Codes by document, and postings range-clustered by (feature, document).

    The compound range splits a feature shared by much of the corpus over many files,
    and sorted files let a lookup skip the row groups of other features.
    """
    spark = index.docs.sparkSession
    remove(spark, f"{path}/log/{name}")  # a rewritten part counts only when it is whole again
    index.docs.select("doc_idx", "code").write.mode("overwrite").parquet(f"{path}/docs/{name}")
    (index.postings.select("feature_id", "doc_idx", "weight", "doc_norm")
     .repartitionByRange("feature_id", "doc_idx").sortWithinPartitions("feature_id", "doc_idx")
     .write.mode("overwrite").parquet(f"{path}/postings/{name}"))
    bounds_of(index.postings).write.mode("overwrite").parquet(f"{path}/bounds/{name}")
    if name.startswith("base"):
        _counts(index.postings, index.docs).write.mode("overwrite").parquet(f"{path}/stats/{name}")
    touch(spark, f"{path}/log/{name}")


def _counts(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings per feature, and under feature -1 the number of documents."""
    total = docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).alias("feature_id"), "n")
    return postings.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n")).unionByName(total)


def write_index(index: SparseIndex, path: str, batch: str = "base") -> None:
    """Store `index` as the base of a new index, or with a batch number as the segment of that batch."""
    _write(index, path, "base=-1" if batch == "base" else f"segment={int(batch)}")


def write_segment(rows: DataFrame, path: str, batch: int) -> None:
    """Store `rows(doc_idx, code)` as one batch: codes replace older ones of their documents, null codes delete them.

    Of several rows of one document in a batch the largest code stays, so that a second run gives the
    same; a null is the smallest. Rows without an id are left out.
    """
    one = rows.where("doc_idx is not null").groupBy(F.col("doc_idx").cast("bigint").alias("doc_idx")).agg(F.max("code").alias("code"))
    # the newest state of each document, deleted ones included; only those with a code have postings
    _write(SparseIndex(one, postings_of(one.where("code is not null")), doc_stats_of(one)), path, f"segment={batch}")


def versions(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest whole base, and the whole segments after it, oldest first."""
    found = [name.split("=") for name in child_names(spark, f"{path}/log")]
    bases = [int(v) for kind, v in found if kind == "base"]
    base = max(bases, default=None)
    return base, sorted(int(v) for kind, v in found if kind == "segment" and (base is None or int(v) > base))


def _parts(spark: SparkSession, path: str, side: str, schema: str, segments: list[int]) -> DataFrame:
    """Rows of all segments with the version of each."""
    each = [spark.read.schema(schema).parquet(f"{path}/{side}/segment={v}").withColumn("version", F.lit(v)) for v in segments]
    return functools.reduce(DataFrame.unionByName, each)


def _read(spark: SparkSession, path: str, base: int | None, segments: list[int]) -> SparseIndex:
    empty = base is None
    docs = spark.createDataFrame([], INDEX_DOCS) if empty else spark.read.schema(INDEX_DOCS).parquet(f"{path}/docs/base={base}")
    postings = spark.createDataFrame([], POSTINGS) if empty else spark.read.schema(POSTINGS).parquet(f"{path}/postings/base={base}")
    # bounds of replaced documents stay: too wide a bound loses nothing
    names = [] if empty else [f"{path}/bounds/base={base}"]
    names += [f"{path}/bounds/segment={v}" for v in segments]
    bounds = None
    if names:
        bounds = spark.read.schema(BOUNDS).option("recursiveFileLookup", "true").parquet(*names)
        bounds = bounds.groupBy("feature_id", "block").agg(*[f(c).alias(c) for f, c in (
            (F.max, "top"), (F.min, "low"), (F.max, "top_share"), (F.min, "low_share"))]) if segments else bounds
    if not segments:
        return SparseIndex(docs, postings, doc_stats_of(docs), bounds)
    newer = _parts(spark, path, "docs", INDEX_DOCS, segments)
    last = newer.groupBy("doc_idx").agg(F.max("version").alias("version"))
    few = newer.limit(TOUCHED_BROADCAST + 1).count() <= TOUCHED_BROADCAST
    last = F.broadcast(last) if few else last
    live = newer.where("code is not null").join(last, ["doc_idx", "version"]).select("doc_idx", "code")
    docs = docs.join(last, "doc_idx", "left_anti").unionByName(live)
    added = _parts(spark, path, "postings", POSTINGS, segments).join(last, ["doc_idx", "version"])
    columns = ["feature_id", "doc_idx", "weight", "doc_norm"]
    postings = postings.join(last, "doc_idx", "left_anti").select(*columns).unionByName(added.select(*columns))
    return SparseIndex(docs, postings, doc_stats_of(docs), bounds)


def read_index(spark: SparkSession, path: str) -> SparseIndex:
    """The index as of its last whole segment: every document once, in its newest state.

    Only the ids of later segments meet the base; neither its codes nor its postings are shuffled
    while those ids are few enough to broadcast.
    """
    return _read(spark, path, *versions(spark, path))


def compact_index(spark: SparkSession, path: str) -> int | None:
    """Write base and segments as one new base and return its version; the old parts stay until `vacuum_index`."""
    base, segments = versions(spark, path)
    if not segments:
        return base
    _write(_read(spark, path, base, segments), path, f"base={segments[-1]}")
    return segments[-1]


def vacuum_index(spark: SparkSession, path: str) -> None:
    """Delete the parts that the newest base replaces: log entries first, so that none names a missing folder."""
    base, _ = versions(spark, path)
    for name in child_names(spark, f"{path}/log"):
        kind, version = name.split("=")
        if base is not None and (int(version) < base or (kind == "segment" and int(version) == base)):
            remove(spark, f"{path}/log/{name}")
    kept = set(child_names(spark, f"{path}/log"))
    for side in ("docs", "postings", "bounds", "stats"):
        for name in child_names(spark, f"{path}/{side}"):
            version = int(name.split("=")[1])
            if name not in kept and base is not None and version <= base:
                remove(spark, f"{path}/{side}/{name}")


def stored_index_stats(spark: SparkSession, path: str) -> DataFrame:
    """`index_stats` of the stored index from the base's stored counts and the documents that segments touch.

    The counts of touched documents in the base are taken away, those of their newest state are added; the
    base's postings are not read.
    """
    base, segments = versions(spark, path)
    counts = spark.createDataFrame([], STATS) if base is None else spark.read.schema(STATS).parquet(f"{path}/stats/base={base}")
    if segments:
        newer = _parts(spark, path, "docs", INDEX_DOCS, segments)
        last = newer.groupBy("doc_idx").agg(F.max("version").alias("version"))
        live = newer.where("code is not null").join(last, ["doc_idx", "version"]).select("doc_idx", "code")
        counts = counts.unionByName(_counts(postings_of(live), live))
        if base is not None:
            old = spark.read.schema(INDEX_DOCS).parquet(f"{path}/docs/base={base}").join(last, "doc_idx", "left_semi")
            counts = counts.unionByName(_counts(postings_of(old), old).withColumn("n", -F.col("n")))
    counts = counts.groupBy("feature_id").agg(F.sum("n").alias("n")).where("n > 0")
    one = counts.agg(F.coalesce(F.max(F.when(F.col("feature_id") == -1, F.col("n"))), F.lit(0)).alias("num_docs"),
                     F.count(F.when(F.col("feature_id") >= 0, 1)).alias("features_used"),
                     F.coalesce(F.sum(F.when(F.col("feature_id") >= 0, F.col("n"))), F.lit(0)).alias("entries"))
    return one.select("num_docs", "features_used", one_decimal(F.try_divide("entries", "features_used")).alias("avg_posting_length"),
                      one_decimal(F.try_divide("entries", "num_docs")).alias("avg_doc_length"))
