"""Sparse and compressed coding of dense vectors.

Coders are map-only: the weights are broadcast after a size check and every Arrow
batch is one matrix product. A coder over the bound is cut by features into
pieces that are broadcast one by one; a worker lets a group of rows wait while it goes through the pieces,
of which it holds one at a time. Neither rows nor weights are shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..session import BROADCAST_BYTES, row_stats
from . import blocks

CODE_FIELDS = f"code {V.CODE_TYPE}"
WEIGHTS_SCHEMA = "feature_id int, enc array<float>, enc_bias float, dec array<float>"
MODEL_TYPES = ("sae", "encoder_only")
# Of a coder over the broadcast bound: weights that a worker holds at a time, and rows that wait for them.
SHARD_BYTES = 128 * 1024 * 1024
GROUP_BYTES = 64 * 1024 * 1024


@dataclass
class SparseCoder:
    """TopK coder: `enc` and `dec` are (features, dim), `dec_bias` is (dim,)."""

    enc: np.ndarray
    enc_bias: np.ndarray
    dec: np.ndarray | None
    dec_bias: np.ndarray | None
    k: int
    model_type: str = "sae"
    tied: bool = False
    pre_bias: bool = True
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.model_type not in MODEL_TYPES:
            raise ValueError(f"unknown model type {self.model_type!r}")

    @property
    def dict_size(self) -> int:
        return self.enc.shape[0]

    @property
    def dim(self) -> int:
        return self.enc.shape[1]

    @property
    def centred(self) -> bool:
        return (self.model_type == "sae" and self.pre_bias and not self.tied
                and self.dec_bias is not None)

    def sparsity(self, k: int | None) -> int:
        return max(1, min(self.k if k is None else int(k), self.dict_size))

    def pre_activations(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != self.dim:
            raise ValueError(f"vectors have {x.shape[1]} dims, the coder expects {self.dim}")
        if self.centred:
            x = x - self.dec_bias.astype(np.float64)
        out = np.empty((len(x), self.dict_size))
        for a in range(0, self.dict_size, 4096):  # only a slice of the weights is widened at a time
            part = slice(a, a + 4096)
            out[:, part] = x @ self.enc[part].T.astype(np.float64) + self.enc_bias[part]
        return out

    def top(self, x: np.ndarray, k: int):
        """Best k positive activations of each vector: screened in single, decided in double precision.

        The slack covers the rounding of the inputs and of a sum of `dim` products and a bias.
        """
        if x.shape[1] != self.dim:
            raise ValueError(f"vectors have {x.shape[1]} dims, the coder expects {self.dim}")
        n, k = len(x), min(k, self.dict_size)
        if self.enc.dtype != np.float32 or n == 0:
            return top_codes(self.pre_activations(x), k)
        if self.centred:
            x = x - self.dec_bias.astype(np.float64)
        rough = x.astype(np.float32) @ self.enc.T
        rough += self.enc_bias
        unit = (self.dim + 4) * 2.0 ** -24
        slack = 1.01 * unit / (1 - unit) * (
            np.linalg.norm(x, axis=1) * self.longest + float(np.abs(self.enc_bias).max(initial=0)))
        kth = np.partition(rough, self.dict_size - k, axis=1)[:, self.dict_size - k].astype(np.float64)
        bound = np.maximum(kth - 2 * slack - blocks.MARGIN, -slack).astype(np.float32)
        rows, cols = np.nonzero(rough >= np.nextafter(bound, np.float32(-np.inf))[:, None])
        values, step = np.empty(len(rows)), max(1, (1 << 22) // self.dim)
        for a in range(0, len(rows), step):
            part = slice(a, a + step)
            values[part] = np.einsum("ij,ij->i", x[rows[part]], self.enc[cols[part]].astype(np.float64))
        values += self.enc_bias[cols]
        keep = values > 0
        return first_of_rows(rows[keep], cols[keep], values[keep], k, n)

    @functools.cached_property
    def longest(self) -> float:
        """Largest norm of an encoder row."""
        return float(np.sqrt(np.einsum("ij,ij->i", self.enc, self.enc, dtype=np.float64).max(initial=0)))

    def reconstruct(self, offsets, features, weights) -> np.ndarray:
        """Decode a batch of codes. A tied decoder has no output bias of its own."""
        table = self.enc if self.tied else self.dec
        if table is None:
            raise ValueError("this coder has no decoder")
        out = np.zeros((len(offsets) - 1, self.dim))
        longest = max(1, int(np.diff(offsets).max(initial=0)))
        step = max(1, (1 << 22) // (self.dim * longest))  # rows expanded at once
        for a in range(0, len(out), step):
            cuts = offsets[a:a + step + 1]
            part = slice(cuts[0], cuts[-1])
            used = np.nonzero(np.diff(cuts))[0]
            if len(used):
                terms = table[features[part]].astype(np.float64) * weights[part, None]
                out[a + used] = np.add.reduceat(terms, cuts[used] - cuts[0])
        if not self.tied and self.dec_bias is not None:
            out += self.dec_bias.astype(np.float64)
        return out

    def to_frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        dec = self.dec if self.dec is not None else np.zeros_like(self.enc)

        def rows(m):
            return pa.FixedSizeListArray.from_arrays(
                pa.array(np.ascontiguousarray(m, np.float32).ravel()), m.shape[1]).cast(
                pa.list_(pa.float32()))

        weights = spark.createDataFrame(pa.table({
            "feature_id": pa.array(np.arange(self.dict_size, dtype=np.int32)),
            "enc": rows(self.enc), "enc_bias": pa.array(self.enc_bias.astype(np.float32)),
            "dec": rows(dec)})).to(_weights_type())
        bias = None if self.dec_bias is None else [float(v) for v in self.dec_bias]
        meta = spark.createDataFrame(
            [(self.dim, self.dict_size, int(self.k), self.model_type, self.tied,
              self.pre_bias, self.dec is not None, bias)], META_SCHEMA)
        return weights, meta


META_SCHEMA = ("input_dim int, dict_size int, current_k int, model_type string, tied boolean, "
               "pre_bias boolean, has_decoder boolean, dec_bias array<float>")


def _weights_type():
    from pyspark.sql.types import StructType
    return StructType.fromDDL(WEIGHTS_SCHEMA)


def coder_from_frames(weights: DataFrame, meta: DataFrame) -> SparseCoder:
    """Load a coder on the driver; refuses weights over the broadcast bound."""
    m = meta.first()
    if m is None:
        raise ValueError("model metadata is missing")
    if m["dict_size"] * m["input_dim"] * 8 > BROADCAST_BYTES * 2:
        raise ValueError("weights are over the bound for one process: use StoredCoder")
    table = weights.orderBy("feature_id").toArrow()
    if table.num_rows != m["dict_size"]:
        raise ValueError(f"{table.num_rows} weight rows for dictionary size {m['dict_size']}")
    enc = blocks.list_matrix(table["enc"]).astype(np.float32)
    if enc.shape[1] != m["input_dim"]:
        raise ValueError(f"weights have {enc.shape[1]} dims, metadata says {m['input_dim']}")
    dec = blocks.list_matrix(table["dec"]).astype(np.float32) if m["has_decoder"] else None
    bias = None if m["dec_bias"] is None else np.asarray(m["dec_bias"], np.float32)
    return SparseCoder(enc, table["enc_bias"].to_numpy().astype(np.float32), dec, bias,
                       m["current_k"], m["model_type"], m["tied"], m["pre_bias"])


# ---------------------------------------------------------------- Arrow plumbing

def codes_array(rows: np.ndarray, features: np.ndarray, weights: np.ndarray, n: int) -> pa.Array:
    """Entries sorted by row -> packed code column."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    entries = pa.StructArray.from_arrays(
        [pa.array(features.astype(np.int32)), pa.array(weights.astype(np.float32))],
        names=["feature_id", "weight"])
    return pa.ListArray.from_arrays(pa.array(offsets), entries)


def vectors_array(m: np.ndarray) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.astype(np.float32).ravel()))


def top_codes(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k best positive activations of each row, strongest first, ties to the lower feature."""
    n, width = h.shape
    k = min(k, width)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bound = np.partition(h, width - k, axis=1)[:, width - k] - blocks.MARGIN
    rows, cols = np.nonzero((h >= bound[:, None]) & (h > 0))
    return first_of_rows(rows, cols, h[rows, cols], k, n)


def first_of_rows(rows, cols, values, k: int, n: int):
    order = np.lexsort((cols, -np.round(values, blocks.DECIMALS), rows))
    rows, cols, values = rows[order], cols[order], values[order]
    position = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows]
    keep = position < k
    return rows[keep], cols[keep], values[keep]


def map_vectors(df: DataFrame, column: str, compute, added: str, row_limit: int = 4096) -> DataFrame:
    """Append the `added` columns, computed by `compute(matrix) -> [arrays]`; `column` is kept."""
    from pyspark.sql.types import StructType
    schema = StructType(df.schema.fields + StructType.fromDDL(added).fields)
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, row_limit):
                part = batch.slice(start, row_limit)
                arrays = compute(blocks.list_matrix(part.column(column)))
                yield pa.RecordBatch.from_arrays(list(part.columns) + list(arrays), names=names)

    return df.mapInArrow(run, schema)


class Shared:
    """A model broadcast as its plain fields and rebuilt inside the task.

    Broadcast values are pickled by reference to their class, which executors without
    this package could not resolve; arrays and numbers they can.
    """

    def __init__(self, spark: SparkSession, model):
        self.kind = type(model)
        self.fields = spark.sparkContext.broadcast({f.name: getattr(model, f.name) for f in fields(model)})

    @functools.cached_property
    def value(self):
        return self.kind(**self.fields.value)

    def take(self):
        """The model for one use in a worker, which doesn't keep it: it is read from the local copy again."""
        return self.kind(**blocks.once(self.fields))

    def destroy(self) -> None:
        self.fields.destroy()


def _share(df: DataFrame, model, n_bytes: int) -> Shared:
    if n_bytes > BROADCAST_BYTES:
        raise ValueError(f"{n_bytes} bytes of weights are over the broadcast bound")
    return Shared(df.sparkSession, model)


class Shards:
    """A coder cut by features: (first feature, coder of the piece), each piece broadcast by itself."""

    def __init__(self, spark: SparkSession, pieces: Iterable[tuple[int, SparseCoder]]):
        self.pieces = [(first, Shared(spark, part)) for first, part in pieces]

    def __iter__(self) -> Iterator[tuple[int, SparseCoder]]:
        for first, shared in self.pieces:
            yield first, shared.take()

    def top(self, x: np.ndarray, k: int, count: bool = False):
        """`SparseCoder.top` over all pieces, and with `count` the number of positive activations of each vector."""
        best, positive = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.zeros(len(x), np.int64)
        for first, part in self:
            found, step = [best], row_limit(part.dict_size)
            for a in range(0, len(x), step):
                if count:
                    h = part.pre_activations(x[a:a + step])
                    positive[a:a + step] += (h > 0).sum(axis=1)
                    rows, cols, values = top_codes(h, k)
                else:
                    rows, cols, values = part.top(x[a:a + step], k)
                found.append((rows + a, cols + first, values))
            best = first_of_rows(*(np.concatenate(f) for f in zip(*found)), k, len(x))
        return (best, positive) if count else best

    def reconstruct(self, offsets, features, weights) -> np.ndarray:
        """`SparseCoder.reconstruct`: each piece adds the terms of its features."""
        n, out, bias = len(offsets) - 1, None, None
        owner = np.repeat(np.arange(n), np.diff(offsets))
        for first, part in self:
            table = part.enc if part.tied else part.dec
            here = (features >= first) & (features < first + len(table))
            cuts = np.concatenate([[0], np.cumsum(np.bincount(owner[here], minlength=n))])
            terms = replace(part, dec_bias=None).reconstruct(cuts, features[here] - first, weights[here])
            out = terms if out is None else out + terms
            bias = None if part.tied else part.dec_bias
        return out if bias is None else out + bias


def cut(coder: SparseCoder, shard_bytes: int) -> Iterator[tuple[int, SparseCoder]]:
    """Pieces of a coder of about `shard_bytes` each, one feature at least."""
    n = max(len(coder.enc), 0 if coder.dec is None else len(coder.dec))
    per_feature = max(1, sum(a.nbytes for a in (coder.enc, coder.dec) if a is not None) // max(1, n))
    width = max(1, shard_bytes // per_feature)
    for a in range(0, max(1, n), width):
        part = slice(a, a + width)
        yield a, replace(coder, enc=coder.enc[part], enc_bias=coder.enc_bias[part], dec=None if coder.dec is None else coder.dec[part])


@dataclass
class StoredCoder:
    """A coder that is applied from its weight table, one feature range on the driver at a time."""

    weights: DataFrame
    meta: dict
    shard_features: int | None = None

    @property
    def tied(self) -> bool:
        return self.meta["tied"]

    @property
    def dict_size(self) -> int:
        return self.meta["dict_size"]

    def sparsity(self, k: int | None) -> int:
        return max(1, min(self.meta["current_k"] if k is None else int(k), self.dict_size))

    def cut(self, shard_bytes: int, enc: bool = True, dec: bool = True) -> Iterator[tuple[int, SparseCoder]]:
        m = self.meta
        if dec and not (m["tied"] or m["has_decoder"]):
            raise ValueError("this coder has no decoder")
        sides = (enc or m["tied"]) + (dec and not m["tied"])
        width = self.shard_features or max(1, shard_bytes // (4 * m["input_dim"] * max(1, sides)))
        bias = None if m["dec_bias"] is None else np.asarray(m["dec_bias"], np.float32)
        for a in range(0, m["dict_size"], width):
            table = self.weights.where(F.col("feature_id").between(a, a + width - 1)).orderBy("feature_id").toArrow()
            if table["feature_id"].to_pylist() != list(range(a, min(a + width, m["dict_size"]))):
                raise ValueError(f"weight rows {a} to {a + width - 1} are not complete")
            none = np.zeros((0, m["input_dim"]), np.float32)
            yield a, SparseCoder(
                blocks.list_matrix(table["enc"]).astype(np.float32) if enc or m["tied"] else none,
                table["enc_bias"].to_numpy().astype(np.float32) if enc else np.zeros(0, np.float32),
                blocks.list_matrix(table["dec"]).astype(np.float32) if dec and not m["tied"] else None,
                bias, m["current_k"], m["model_type"], m["tied"], m["pre_bias"])


def stored_coder(weights: DataFrame, meta: DataFrame, shard_features: int | None = None) -> StoredCoder:
    found = meta.first()
    if found is None:
        raise ValueError("model metadata is missing")
    return StoredCoder(weights, found.asDict(), shard_features)


def share(df: DataFrame, coder: SparseCoder | StoredCoder, bound: int | None, part, **sides) -> Shared | Shards:
    """The coder broadcast whole within the bound, or in pieces."""
    bound = BROADCAST_BYTES if bound is None else bound
    if isinstance(coder, StoredCoder):
        return Shards(df.sparkSession, coder.cut(min(bound, SHARD_BYTES), **sides))
    coder = part(coder)
    if _coder_bytes(coder) <= bound:
        return Shared(df.sparkSession, coder)
    return Shards(df.sparkSession, cut(coder, min(bound, SHARD_BYTES)))


def _map_groups(df: DataFrame, column: str, compute, added: str) -> DataFrame:
    """Append the `added` columns, computed by `compute(Arrow column) -> [arrays]` on groups of rows."""
    from pyspark.sql.types import StructType
    schema = StructType(df.schema.fields + StructType.fromDDL(added).fields)
    names, limit = [f.name for f in schema.fields], GROUP_BYTES

    def run(batches):
        for held in blocks.grouped(batches, limit):
            group = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays(list(group.columns) + list(compute(group.column(column))), names=names)

    return df.mapInArrow(run, schema)


def _coder_bytes(coder: SparseCoder) -> int:
    return sum(a.nbytes for a in (coder.enc, coder.dec, coder.enc_bias, coder.dec_bias)
               if a is not None)


def _encoder_part(coder: SparseCoder) -> SparseCoder:
    """The coder without what encoding doesn't read."""
    return replace(coder, dec=None, dec_bias=coder.dec_bias if coder.centred else None)


def _decoder_part(coder: SparseCoder) -> SparseCoder:
    """The coder without what decoding doesn't read; a tied decoder is the encoder."""
    none = np.zeros((0, coder.dim), np.float32)
    return replace(coder, enc=coder.enc if coder.tied else none, enc_bias=np.zeros(0, np.float32),
                   dec=None if coder.tied else coder.dec)


def row_limit(width: int) -> int:
    return int(min(8192, max(64, (1 << 23) // max(1, width))))


# ---------------------------------------------------------------- sparse coder

def encode(dense: DataFrame, coder: SparseCoder | StoredCoder, k: int | None = None,
           column: str = "embedding", output: str = "code", bound: int | None = None) -> DataFrame:
    """Append packed TopK codes, strongest first, positive weights only.

    Weights over `bound` bytes (the broadcast bound by default), and stored ones, are applied piece by piece.
    """
    k = coder.sparsity(k)
    shared = share(dense, coder, bound, _encoder_part, dec=False)
    if isinstance(shared, Shards):
        def pieces(vectors):
            x = blocks.list_matrix(vectors)
            return [codes_array(*shared.top(x, k), len(x))]

        return _map_groups(dense, column, pieces, f"{output} {V.CODE_TYPE}")

    def compute(x):
        return [codes_array(*shared.value.top(x, k), len(x))]

    return map_vectors(dense, column, compute, f"{output} {V.CODE_TYPE}", row_limit(coder.dict_size))


def encode_sharded(dense: DataFrame, weights: DataFrame, meta: DataFrame, k: int | None = None,
                   shard_features: int = 8192) -> DataFrame:
    """`encode` for `dense(row_idx, embedding)` by a weight table that the driver can't hold whole."""
    return encode(dense, stored_coder(weights, meta, shard_features), k).select("row_idx", "code")


def active_features(codes: DataFrame, column: str = "code") -> DataFrame:
    """Long form of the codes with `code_rank` from 1, strongest first."""
    keep = [c for c in codes.columns if c != column]
    return codes.select(*keep, F.posexplode(column).alias("code_rank", "e")).select(
        *keep, F.col("e.feature_id").alias("feature_id"), F.col("e.weight").alias("weight"),
        (F.col("code_rank") + 1).alias("code_rank"))


def pack_codes(long: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse of `active_features`."""
    entry = F.struct("code_rank", "feature_id", "weight")
    return long.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("e")).select(
        *keys, F.transform("e", lambda x: F.struct(
            x["feature_id"].alias("feature_id"), x["weight"].alias("weight"))).alias("code"))


def decode(codes: DataFrame, coder: SparseCoder | StoredCoder, column: str = "code", output: str = "x_hat",
           bound: int | None = None) -> DataFrame:
    """Append the decoded vectors; a decoder over `bound` bytes, or a stored one, adds up piece by piece."""
    from pyspark.sql.types import StructType
    if isinstance(coder, SparseCoder) and (coder.enc if coder.tied else coder.dec) is None:
        raise ValueError("this coder has no decoder")
    shared = share(codes, coder, bound, _decoder_part, enc=False)
    if isinstance(shared, Shards):
        return _map_groups(codes, column, lambda c: [vectors_array(shared.reconstruct(*blocks.code_arrays(c)))], f"{output} array<float>")
    schema = StructType(codes.schema.fields + StructType.fromDDL(f"{output} array<float>").fields)
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            x_hat = shared.value.reconstruct(*blocks.code_arrays(batch.column(column)))
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [vectors_array(x_hat)], names=names)

    return codes.mapInArrow(run, schema)


def forward(dense: DataFrame, coder: SparseCoder | StoredCoder, k: int | None = None,
            column: str = "embedding", bound: int | None = None) -> DataFrame:
    """Code, reconstruction and activation counts of every vector in one pass."""
    k = coder.sparsity(k)
    if isinstance(coder, SparseCoder) and (coder.enc if coder.tied else coder.dec) is None:
        raise ValueError("this coder has no decoder")
    shared = share(dense, coder, bound, lambda whole: whole)
    whole = isinstance(shared, Shared)

    def outcome(x, best, positive, reconstruct):
        rows, cols, w = best
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(x)))])
        return [codes_array(rows, cols, w, len(x)), vectors_array(reconstruct(offsets, cols, w)),
                pa.array(np.diff(offsets).astype(np.int32)), pa.array(positive.astype(np.int32))]

    def compute(x):
        h = shared.value.pre_activations(x)
        return outcome(x, top_codes(h, k), (h > 0).sum(axis=1), shared.value.reconstruct)

    def pieces(vectors):
        x = blocks.list_matrix(vectors)
        return outcome(x, *shared.top(x, k, count=True), shared.reconstruct)

    added = f"{CODE_FIELDS}, x_hat array<float>, active_dims int, positive_pre int"
    if not whole:
        return _map_groups(dense, column, pieces, added)
    return map_vectors(dense, column, compute, added, row_limit(coder.dict_size))


def normalize_decoder(weights: DataFrame) -> DataFrame:
    """Unit-norm dictionary vectors."""
    return weights.withColumn("dec", V.l2_normalize("dec", "clamp"))


def raw_topk_encode(dense: DataFrame, k: int, column: str = "embedding", output: str = "code") -> DataFrame:
    """Append the k largest dimensions by absolute value, sign kept, zeros dropped.

    Same codes as the column function `raw_topk`, in bulk: a partial selection per batch
    where the column function sorts every vector.
    """
    if k <= 0:
        raise ValueError("k must be positive")

    def compute(x):
        size = np.abs(x)
        rows, cols = blocks.top_columns(np.where(size > 0, size, -np.inf), k)
        order = np.lexsort((cols, -size[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        return [codes_array(rows, cols, x[rows, cols], len(x))]

    return map_vectors(dense, column, compute, f"{output} {V.CODE_TYPE}")


# ---------------------------------------------------------------- dense compression

@dataclass
class DenseAE:
    """Linear or two-layer GELU autoencoder; matrices are (out, in)."""

    enc: list[tuple[np.ndarray, np.ndarray]]
    dec: list[tuple[np.ndarray, np.ndarray]]
    normalize: bool = True

    @property
    def architecture(self) -> str:
        return "linear" if len(self.enc) == 1 else "mlp"

    @property
    def bottleneck(self) -> int:
        return self.enc[-1][0].shape[0]

    @property
    def n_bytes(self) -> int:
        return sum(w.nbytes + b.nbytes for w, b in self.enc + self.dec)

    def encode(self, x: np.ndarray, normalize: bool | None = None) -> np.ndarray:
        z = _stack(x, self.enc)
        if self.normalize if normalize is None else normalize:
            z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), V.EPS)
        return z

    def decode(self, z: np.ndarray) -> np.ndarray:
        return _stack(z, self.dec)


def _stack(x: np.ndarray, layers) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w.T.astype(np.float64) + b.astype(np.float64)
        if i + 1 < len(layers):
            x = gelu(x)
    return x


def erf(x: np.ndarray) -> np.ndarray:
    """Error function of all elements at once, to 1e-14.

    Up to 2.5 by its power series with positive terms, above by the continued fraction of the
    complement, both with a fixed number of steps that suffices for the worst element.
    """
    size = np.abs(x)
    square = size * size
    low = np.minimum(size, 2.5)
    term, total = low.copy(), low.copy()
    for n in range(1, 60):
        term = term * (2 * low * low / (2 * n + 1))
        total = total + term
    series = 2 / np.sqrt(np.pi) * np.exp(-low * low) * total
    high = np.maximum(size, 2.5)
    tail = high
    for n in range(60, 0, -1):
        tail = high + (n / 2) / tail
    beyond = 1 - np.exp(-np.minimum(square, 700.0)) / (np.sqrt(np.pi) * tail)
    return np.sign(x) * np.where(size <= 2.5, series, beyond)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + erf(x / np.sqrt(2.0)))


def hidden_dim(dim: int, bottleneck: int) -> int:
    return min(dim, max(512, 4 * bottleneck))


def ae_encode(dense: DataFrame, model: DenseAE, normalize: bool | None = None,
              column: str = "embedding", output: str = "latent") -> DataFrame:
    shared = _share(dense, model, model.n_bytes)
    return map_vectors(dense, column, lambda x: [vectors_array(shared.value.encode(x, normalize))],
                       f"{output} array<float>")


def ae_forward(dense: DataFrame, model: DenseAE, column: str = "embedding") -> DataFrame:
    shared = _share(dense, model, model.n_bytes)

    def compute(x):
        model = shared.value
        z = model.encode(x, normalize=False)  # the raw latent is decoded, only the returned code is normalised
        latent = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), V.EPS) if model.normalize else z
        return [vectors_array(latent), vectors_array(model.decode(z))]

    return map_vectors(dense, column, compute, "latent array<float>, x_hat array<float>")


@dataclass
class PCAModel:
    mean: np.ndarray         # (dim,)
    components: np.ndarray   # (dim, out)
    method: str
    n_fit: int

    @property
    def n_bytes(self) -> int:
        return self.mean.nbytes + self.components.nbytes


def pca_fit(docs: DataFrame, dim: int, max_docs: int | None = None, seed: int = 42) -> PCAModel:
    """Exact PCA of `docs(row_idx, embedding)`, all rows unless a sample size is given.

    When nothing is reduced the components are the identity; vectors are centred all the same.

    Mean and covariance are aggregated by the cluster, the driver sees dim x dim numbers.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    from .relevance import seeded_sample

    n = docs.count()
    if n == 0:  # nothing to centre or to turn
        return PCAModel(np.zeros(0), np.zeros((0, 0)), "identity", 0)
    d = docs.select(F.size("embedding").alias("d")).first()["d"]
    sample = docs if max_docs is None else seeded_sample(docs, n, max_docs, seed)
    vectors = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    mean = vectors.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    n_fit = n if max_docs is None else min(n, max_docs)
    if dim >= d:
        return PCAModel(mean, np.eye(d), "identity", n_fit)
    fitted = PCA(k=dim, inputCol="v", outputCol="p").fit(vectors)
    return PCAModel(mean, fitted.pc.toArray(), "pca_exact", n_fit)


def pca_project(dense: DataFrame, model: PCAModel, column: str = "embedding",
                output: str = "latent") -> DataFrame:
    shared = _share(dense, model, model.n_bytes)
    return map_vectors(
        dense, column,
        lambda x: [vectors_array((x - shared.value.mean) @ shared.value.components)],
        f"{output} array<float>")
