"""Benchmark records: items, annotations, judgments, captions and image payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import items as I
from ..session import cut_lineage

QUERY_SCHEMA = ("qid string, query_txt string, query_img_path string, query_modality string, "
                "pos_cand_list array<string>, neg_cand_list array<string>")
CANDIDATE_SCHEMA = "did string, txt string, img_path string, modality string"
BROADCAST_SPLITS = 100_000  # rows of the split table that are broadcast at most

CAPTION_SCHEMA = (
    "images array<struct<filename: string, split: string, imgid: bigint, cocoid: bigint, "
    "sentences: array<struct<tokens: array<string>, raw: string, imgid: bigint, sentid: bigint>>>>")

# Corpus splits that make up each requested split.
CAPTION_SPLITS = {"train": ("train", "restval"), "validation": ("val",), "test": ("test",)}


def read_jsonl(spark: SparkSession, path, schema: str, max_items: int = 0) -> DataFrame:
    """JSON lines with `row_idx` in file order; blank lines skipped, a malformed line fails.

    The parsed rows are staged once, because file splits are planned anew by every job and
    may differ when executors come or go. Rows are then counted per split, the counts are
    summed up to offsets (over files, then inside a file), and every row adds its position inside its
    split. The running sum over files reads one row per file.
    """
    raw = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    names = raw.columns
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_id"))
    raw = cut_lineage(raw)
    splits = cut_lineage(raw.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first")))
    files = splits.groupBy("_file").agg(F.sum("n").alias("total")).withColumn(
        "before", F.sum("total").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(splits.withColumn("inside", F.sum("n").over(within)).join(files, "_file").select(
        "_file", "_block", "_first", (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("_offset")))
    if starts.count() <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    out = raw.join(starts, ["_file", "_block"]).select(
        (F.col("_offset") + F.col("_id") - F.col("_first")).alias("row_idx"), *names)
    return out.where(F.col("row_idx") < max_items) if max_items > 0 else out


def to_items(raw: DataFrame, kind: str) -> DataFrame:
    """Raw query or candidate records -> the common item table."""
    none = F.lit(None).cast("array<string>")
    if kind == "query":
        text, image, modality = "query_txt", "query_img_path", "query_modality"
        pos, neg = F.col("pos_cand_list"), F.col("neg_cand_list")
    elif kind == "candidate":
        text, image, modality = "txt", "img_path", "modality"
        pos, neg = none, none
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return raw.select(
        F.lit(kind).alias("kind"), "row_idx", I.item_id(kind).alias("item_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(image).alias("image_path"),
        I.item_modality(modality, text, image).alias("modality"),
        pos.alias("pos_ids"), neg.alias("neg_ids"))


def read_items(spark: SparkSession, path, kind: str, max_items: int = 0) -> DataFrame:
    schema = QUERY_SCHEMA if kind == "query" else CANDIDATE_SCHEMA
    return to_items(read_jsonl(spark, path, schema, max_items), kind)


def annotations(raw: DataFrame) -> DataFrame:
    """`qid, pos_ids, neg_ids`: rows without qid dropped, the last row of a qid wins."""
    last = raw.where(F.col("qid").isNotNull()).groupBy(F.col("qid").cast("string").alias("qid")).agg(
        F.max_by(F.struct("pos_cand_list", "neg_cand_list"), "row_idx").alias("a"))
    empty = F.array().cast("array<string>")
    return last.select("qid", F.coalesce("a.pos_cand_list", empty).alias("pos_ids"),
                       F.coalesce("a.neg_cand_list", empty).alias("neg_ids"))


def read_annotations(spark: SparkSession, path) -> DataFrame:
    return annotations(read_jsonl(spark, path, QUERY_SCHEMA))


def parse_qrels(lines: DataFrame, strict: bool = False) -> DataFrame:
    """`qid _ did rel` lines with a positive rel.

    Lines of fewer than four tokens are skipped. Lenient: non-numeric rels are skipped too and
    duplicates stay. Strict: the other lines must carry an integer rel, and the pairs form a set.
    """
    parts = F.split(I.strip("value"), r"\s+")
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 4)
    if strict:
        rows = rows.select(
            F.element_at("p", 1).alias("qid"), F.element_at("p", 3).alias("did"),
            F.when(F.element_at("p", 4).rlike(r"^[+-]?\d+$"), F.element_at("p", 4).try_cast("int"))
            .otherwise(F.raise_error(F.concat(F.lit("bad rel "), F.element_at("p", 4))).cast("int"))
            .cast("double").alias("rel"))
        return rows.where(F.col("rel") > 0).dropDuplicates(["qid", "did"])
    rows = rows.select(
        F.element_at("p", 1).alias("qid"), F.element_at("p", 3).alias("did"),
        F.element_at("p", 4).try_cast("double").alias("rel"))
    return rows.where(F.col("rel") > 0)


def read_qrels(spark: SparkSession, path, strict: bool = False) -> DataFrame:
    return parse_qrels(spark.read.text(path), strict)


def _plain_path(path) -> F.Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def image_listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths under `root`; the binary content is pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_plain_path(F.col("path")).alias("path"))


def captions(images: DataFrame, split: str, root: str, listing: DataFrame | None = None) -> DataFrame:
    """One row per caption of the requested split, for images that exist."""
    if split not in CAPTION_SPLITS:
        raise ValueError(f"unknown split {split!r}")
    one = images.select(F.explode("images").alias("i")).where(
        F.col("i.split").isin(list(CAPTION_SPLITS[split])))
    folder = F.when(F.col("i.filename").contains("val2014"), "val2014").otherwise("train2014")
    rows = one.select(
        F.concat(F.lit(root.rstrip("/") + "/"), folder, F.lit("/"), F.col("i.filename")).alias("path"),
        F.col("i.filename").alias("filename"), F.col("i.imgid").alias("imgid"),
        F.col("i.cocoid").alias("cocoid"), F.col("i.sentences").alias("sentences"))
    if listing is not None:
        rows = rows.join(listing, "path", "left_semi")
    return rows.select("path", "filename", "imgid", "cocoid", F.explode("sentences").alias("s")).select(
        "path", "filename", "imgid", "cocoid", F.col("s.sentid").alias("sentid"),
        I.strip("s.raw").alias("caption"))


def read_captions(spark: SparkSession, root: str, annotations_path, split: str) -> DataFrame:
    nested = spark.read.schema(CAPTION_SCHEMA).option("multiLine", "true").option(
        "mode", "FAILFAST").json(annotations_path)
    return captions(nested, split, root, image_listing(spark, root))


def attach_images(items: DataFrame, root: str, path_col: str = "image_path") -> DataFrame:
    """Add the image bytes; null where there is no such file.

    Content is read once per file and joined on the path, so many items of one image
    do not read it again.
    """
    files = items.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(_plain_path(F.col("path")).alias("_path"), F.col("content").alias("image"))
    wanted = I.resolve_path(path_col, F.array(F.lit("image")), root)
    return items.withColumn("_path", wanted).join(files, "_path", "left").drop("_path")


def read_items_stream(spark: SparkSession, path: str, kind: str, max_files: int = 1000) -> DataFrame:
    """Items as a stream of JSONL files; the stream's checkpoint takes the place of a skip count."""
    schema = QUERY_SCHEMA if kind == "query" else CANDIDATE_SCHEMA
    raw = spark.readStream.schema(schema).option("mode", "FAILFAST").option(
        "maxFilesPerTrigger", max_files).json(path)
    # position across an unbounded stream has no meaning: items are keyed by id
    return to_items(raw.withColumn("row_idx", F.lit(None).cast("bigint")), kind).drop("row_idx")


def usable_samples(samples: DataFrame, max_samples: int = 0, caption: str = "caption",
                   image_exists: str | None = None) -> DataFrame:
    """Samples with a caption (and an existing image); the first `max_samples` in row order.

    The cut is the caller's choice. It is resolved to a row index first, so the
    data stays distributed.
    """
    kept = samples.where(I.usable_sample(caption, image_exists))
    if max_samples <= 0:
        return kept
    block = (F.col("row_idx") / F.lit(1 << 20)).cast("bigint")
    counts = kept.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    edge = counts.where(F.coalesce("before", F.lit(0)) < max_samples).agg(
        F.max("b").alias("b"), F.max_by(F.coalesce("before", F.lit(0)), "b").alias("before")).first()
    if edge is None or edge["b"] is None:
        return kept
    last = kept.where(block == edge["b"]).orderBy("row_idx").limit(
        int(max_samples - edge["before"])).agg(F.max("row_idx").alias("m")).first()["m"]
    return kept.where(F.col("row_idx") <= last)
