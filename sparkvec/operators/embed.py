"""Batch embedding with any embedder, built once per Python worker."""

from __future__ import annotations

import hashlib
import re
from typing import Callable, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vector import EPS
from .coding import vectors_array


class Embedder(Protocol):
    dim: int

    def embed(self, batch: list[dict]) -> np.ndarray:
        """One vector per request; a request has `text` and `image` (bytes or None)."""


class HashingEmbedder:
    """Deterministic embedder: signed feature hashing of whitespace tokens.

    A token adds +1 or -1 to the component its md5 names: the first eight hex digits
    modulo `dim` give the component, an even ninth digit the plus sign.
    """

    # Tokens whose component an embedder remembers; then it starts anew.
    TOKENS = 500_000

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.known: dict[str, int] = {}

    def _place(self, token: str) -> int:
        """The token's component, and `dim` more for a minus sign."""
        h = hashlib.md5(token.encode()).hexdigest()
        self.known[token] = place = int(h[:8], 16) % self.dim + (self.dim if int(h[8], 16) % 2 else 0)
        return place

    def embed(self, batch: list[dict]) -> np.ndarray:
        if len(self.known) > self.TOKENS:
            self.known = {}
        out = np.zeros((len(batch), self.dim))
        for i, request in enumerate(batch):
            tokens = [t for t in re.split(r"[ \t\n\r\f\v]+", request.get("text") or "") if t]
            places = list(map(self.known.get, tokens))
            if None in places:
                places = [self._place(t) if p is None else p for t, p in zip(tokens, places)]
            counts = np.bincount(np.array(places, np.int64), minlength=2 * self.dim)
            out[i] = counts[:self.dim] - counts[self.dim:]
        return out


def hashing_vectors(texts: DataFrame, key: str, dim: int = 64, text_col: str = "text") -> DataFrame:
    """The embedding of `HashingEmbedder` in column functions: (`key`, f, c) of the components that aren't 0, before any norm.

    Tokens are counted before the shuffle by (key, component), so a long text costs `dim` rows.
    """
    words = texts.select(key, F.explode(F.split(text_col, r"[ \t\n\r\f\x0B]+")).alias("t")).where(F.col("t") != "")
    h = F.md5(F.col("t").cast("binary"))
    bucket = (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return words.groupBy(key, bucket.alias("f")).agg(F.sum(sign).cast("double").alias("c")).where("c <> 0")


_REGISTRY: dict[str, Callable[..., Embedder]] = {"hashing": HashingEmbedder}


def register_embedder(name: str, factory: Callable[..., Embedder]) -> None:
    _REGISTRY[name] = factory


def make_embedder(name: str, **options) -> Embedder:
    if name not in _REGISTRY:
        raise ValueError(f"unknown embedder {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name](**options)


def _embed_batch(embedder: Embedder, requests: list[dict], retry_items: bool) -> np.ndarray:
    try:
        vectors = np.asarray(embedder.embed(requests), np.float64)
    except Exception:
        if not retry_items or len(requests) == 1:
            raise
        # a failing item raises here, on its own
        vectors = np.concatenate([np.asarray(embedder.embed([r]), np.float64) for r in requests])
    if vectors.shape != (len(requests), embedder.dim):
        raise ValueError(f"embedder returned {vectors.shape} for {len(requests)} requests of dim {embedder.dim}")
    return vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + EPS)


def _embed_or_none(embedder: Embedder, requests: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the requests that can be embedded, and which those are."""
    try:
        return _embed_batch(embedder, requests, False), np.ones(len(requests), bool)
    except Exception:
        found = []
        for request in requests:
            try:
                found.append(_embed_batch(embedder, [request], False)[0])
            except Exception:
                found.append(None)
        good = np.array([v is not None for v in found])
        return np.array([v for v in found if v is not None]).reshape(int(good.sum()), embedder.dim), good


def embed(items: DataFrame, factory: Callable[[], Embedder], batch_size: int = 256,
          on_error: str = "raise", output: str = "embedding", text: str = "text",
          image: str | None = None, keep: list[str] | None = None, profile=None) -> DataFrame:
    """Append L2-normalised float vectors to `items`; map-only.

    `factory` runs once per task and may load a model. With on_error="retry_items" a
    failed batch is retried item by item, and an item that fails alone raises.
    `keep` names the columns carried along (by default all of them), so a caller can
    leave the texts behind. `profile` is a ResourceProfile, for embedders that need a GPU per task.
    """
    if on_error not in ("raise", "retry_items"):
        raise ValueError(f"unknown on_error {on_error!r}")
    keep = items.columns if keep is None else keep
    schema = StructType([items.schema[c] for c in keep] + StructType.fromDDL(f"{output} array<float>").fields)
    names = [f.name for f in schema.fields]
    source = items.select(*dict.fromkeys([*keep, text, *([image] if image else [])]))

    def run(batches):
        embedder = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                texts = part.column(text).to_pylist()
                images = part.column(image).to_pylist() if image else [None] * len(texts)
                requests = [{"text": t, "image": i} for t, i in zip(texts, images)]
                vectors = _embed_batch(embedder, requests, on_error == "retry_items")
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [vectors_array(vectors)], names=names)

    return source.mapInArrow(run, schema, profile=profile)


def embed_pairs(items: DataFrame, factory: Callable[[], Embedder], mode: str = "both",
                batch_size: int = 256, image: str = "image") -> DataFrame:
    """`image_emb` and `text_emb` per item; an image that is missing or fails takes the text vector and is flagged.

    Mode "text_only" uses the text vector for both sides.
    """
    if mode not in ("both", "text_only"):
        raise ValueError(f"unknown mode {mode!r}")
    keep = [c for c in items.columns if c not in ("text", image)]
    if mode == "text_only":
        out = embed(items, factory, batch_size, output="text_emb", keep=keep)
        return out.select(*keep, F.col("text_emb").alias("image_emb"), "text_emb",
                          F.lit(True).alias("image_fallback"))
    schema = StructType([items.schema[c] for c in keep] + StructType.fromDDL(
        "image_emb array<float>, text_emb array<float>, image_fallback boolean").fields)
    names = [f.name for f in schema.fields]

    def run(batches):
        embedder = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                texts = part.column("text").to_pylist()
                images = part.column(image).to_pylist()
                text_emb = _embed_batch(embedder, [{"text": t, "image": None} for t in texts], True)
                missing = np.array([i is None for i in images])
                image_emb = text_emb.copy()
                if not missing.all():
                    found = [{"text": None, "image": i} for i in images if i is not None]
                    vectors, good = _embed_or_none(embedder, found)
                    at = np.flatnonzero(~missing)
                    image_emb[at[good]] = vectors
                    missing[at[~good]] = True
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [vectors_array(image_emb), vectors_array(text_emb),
                                                      pa.array(missing)], names=names)

    return items.select(*keep, "text", image).mapInArrow(run, schema)


def require_image(items: DataFrame, image: str = "image") -> DataFrame:
    """An item that wanted an image but has none keeps its text; without text it is an error."""
    lost = F.array_contains("modality", "image") & F.col(image).isNull()
    hopeless = lost & (F.coalesce("text", F.lit("")) == "")
    checked = F.when(hopeless, F.raise_error(F.concat(
        F.lit("image missing for item "), F.col("item_id"))).cast("string")).otherwise(F.col("text"))
    return items.withColumn("degraded", lost).withColumn("text", checked)


def embed_route(items: DataFrame) -> DataFrame:
    """"target" for image-only candidates, "query" for everything else; decided per row."""
    image_only = (F.col("kind") == "candidate") & F.array_contains("modality", "image") & (
        F.coalesce("text", F.lit("")) == "")
    return items.withColumn("route", F.when(image_only, F.lit("target")).otherwise(F.lit("query")))


def vector_mean(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Element-wise mean as (pos, mean); partial aggregates keep it one row per dimension and task."""
    return df.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(
        F.avg(F.col("x").cast("double")).alias("mean"))
