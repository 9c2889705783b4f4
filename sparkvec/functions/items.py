"""Column expressions that turn raw benchmark records into embedding requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\v"

# Retrieval prompt per dataset key, and the one for all other datasets.
QUERY_PREFIXES = {
    "fashioniq": "Find a fashion image that aligns with the reference image and style note.",
    "fashion200k": "Find a fashion image that aligns with the reference image and style note.",
    "cirr": "Retrieve a day-to-day image that aligns with the modification instructions of the provided image.",
}
GENERIC_PREFIX = (
    "Retrieve the target image that best matches the reference image and the textual modification.")

# Public image host of the caption corpus, accepted URL schemes, default image.
IMAGE_HOST = "http://images.cocodataset.org"
URL_SCHEMES = ("http://", "https://", "oss://", "file://")
DEFAULT_IMAGE = "file:///image.jpg"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def _text(c) -> Column:
    """Stripped text, "" for null."""
    return F.coalesce(strip(c), F.lit(""))


def item_modality(explicit, text, image) -> Column:
    """Sorted modality set: the explicit comma list, else whatever is non-empty."""
    listed = F.filter(
        F.transform(F.split(F.lower(_col(explicit)), ","), strip), lambda x: x != "")
    inferred = F.array_compact(F.array(
        F.when(F.coalesce(_col(text), F.lit("")) != "", F.lit("text")),
        F.when(F.coalesce(_col(image), F.lit("")) != "", F.lit("image"))))
    return F.array_sort(F.array_distinct(
        F.when(_text(explicit) != "", listed).otherwise(inferred)))


def item_id(kind: str) -> Column:
    """Identifier column of a query ("qid") or candidate ("did") record, as string."""
    if kind not in ("query", "candidate"):
        raise ValueError(f"unknown kind {kind!r}")
    return F.col("qid" if kind == "query" else "did").cast("string")


def prompt_text(text, modality, prefix) -> Column:
    body = F.when(F.array_contains(_col(modality), "text"), _text(text)).otherwise(F.lit(""))
    prefix = F.coalesce(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit(""))
    return F.when((body != "") & (prefix != ""), F.concat(prefix, F.lit("\n"), body)).otherwise(body)


def resolve_path(path, modality, root: str) -> Column:
    path = _col(path)
    joined = F.concat(F.lit(root.rstrip("/") + "/"), path)
    wanted = F.array_contains(_col(modality), "image") & (F.coalesce(path, F.lit("")) != "")
    return F.when(wanted, F.when(path.startswith("/"), path).otherwise(joined))


def default_prefix(dataset) -> Column:
    key = F.split_part(F.lower(_col(dataset)), F.lit("_task"), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in QUERY_PREFIXES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(GENERIC_PREFIX))


def caption(caption, text, sentence_raw, sentences_raw) -> Column:
    """First non-empty of caption, text, the sentence and the first listed sentence."""
    first_listed = F.try_element_at(_col(sentences_raw), F.lit(1))
    choices = [F.nullif(_col(c), F.lit("")) for c in (caption, text, sentence_raw)]
    return _text(F.coalesce(*choices, first_listed))


def image_url(filename) -> Column:
    name = F.nullif(_col(filename), F.lit(""))
    folder = F.when(name.contains("val2014"), F.lit("val2014")).otherwise(F.lit("train2014"))
    return F.concat(F.lit(IMAGE_HOST + "/"), folder, F.lit("/"), name)


def image_ref(path, filename, exists) -> Column:
    """URL as is, existing local file as file://, else the corpus URL, else the default."""
    path = _col(path)
    usable = (F.coalesce(path, F.lit("")) != "") & ~path.contains("zip:")
    is_url = F.lit(False)
    for scheme in URL_SCHEMES:
        is_url = is_url | path.startswith(scheme)
    return (
        F.when(usable & is_url, path)
        .when(usable & F.coalesce(_col(exists), F.lit(False)), F.concat(F.lit("file://"), path))
        .otherwise(F.coalesce(image_url(filename), F.lit(DEFAULT_IMAGE))))


def embed_request(instruction: str, text, image) -> Column:
    """Ordered content parts, image before text; one empty text part if there is neither."""
    def part(kind, value):
        return F.struct(F.lit(kind).alias("type"), value.alias("value"))

    image, text = F.nullif(_col(image), F.lit("")), F.nullif(_col(text), F.lit(""))
    parts = F.array_compact(F.array(
        F.when(image.isNotNull(), part("image", image)),
        F.when(text.isNotNull(), part("text", text))))
    return F.struct(
        F.lit(instruction).alias("system"),
        F.when(F.size(parts) == 0, F.array(part("text", F.lit("")))).otherwise(parts).alias("content"))


def usable_sample(caption_col, image_exists=None) -> Column:
    keep = _text(caption_col) != ""
    return keep if image_exists is None else keep & F.coalesce(_col(image_exists), F.lit(False))
