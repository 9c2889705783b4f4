"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, a gated attention decides how much it counts,
and the weighted sum of the encodings is scored. Only documents have labels; the attention weights are
learned from them by gradient descent on a bounded sample.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches, text_of, texts, widen
from .toxicity import training_rows

PASSAGE_WORDS = 64
# Labelled training rows of each class, at most; all their passages are used.
FIT_ROWS = 2_000
THRESHOLD = 0.7
HIDDEN, GATE = 16, 8
CLASSES = 10
EXTRA = 10
FEATURES = CLASSES * CLASSES + EXTRA

# Character classes: end or white space, lower, upper, digit, other letter bytes, stop, comma, bar, exclamation, other signs.
_CLASS = np.full(256, 9, np.uint8)
for _chars, _kind in ((b" \t\n\r\x0b\x0c", 0), (b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2),
                      (b"0123456789", 3), (bytes(range(128, 256)), 4), (b".?", 5), (b",;:'\"()-", 6), (b"|", 7), (b"!", 8)):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _kind


def passages(text: str) -> list[list[str]]:
    """Consecutive runs of PASSAGE_WORDS words; a shorter rest is a passage of its own. No words give one empty passage."""
    words = text.split()
    return [words[i:i + PASSAGE_WORDS] for i in range(0, len(words), PASSAGE_WORDS)] or [[]]


def describe(words: list[str]) -> np.ndarray:
    """Features of a passage: shares of neighbouring character classes, repetition, and lengths."""
    raw = np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8)
    kinds = _CLASS[raw].astype(np.int64)
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES) / (len(kinds) - 1)
    n = len(words)
    if not n:
        return np.concatenate([np.sqrt(pairs), np.zeros(EXTRA)])
    distinct = len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, n)
    upper = sum(map(str.isupper, words))
    plain = sum(map(str.isalpha, words))
    extra = [distinct / n, same / n, math.log1p(same), upper / n, plain / n, lengths.mean() / 10, lengths.std() / 10,
             (lengths == 1).mean(), math.log1p(n) / 4, lengths.max() / 40]
    return np.concatenate([np.sqrt(pairs), extra])


def encode(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of all texts in a row, and the number of passages of each."""
    bags = [passages(t) for t in items]
    return (np.array([describe(p) for bag in bags for p in bag], np.float32).reshape(-1, FEATURES),
            np.array([len(b) for b in bags], np.int64))


def forward(model: dict, x: np.ndarray, counts: np.ndarray) -> dict:
    """Encodings, attention and logits of the bags."""
    x = (x - model["mean"]) / model["scale"]
    starts = np.cumsum(counts) - counts
    h = np.tanh(x @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-np.clip(h @ model["U"], -30, 30)))
    a = (t * g) @ model["w"]
    e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), counts))
    weight = e / np.repeat(np.add.reduceat(e, starts), counts)
    z = np.add.reduceat(weight[:, None] * h, starts)
    return {"x": x, "h": h, "t": t, "g": g, "a": weight, "z": z, "logit": z @ model["c"] + model["d"], "starts": starts}


def train(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> dict:
    """Fit encoder, gated attention and scorer by Adam on batches of 64 bags; classes weigh alike."""
    r = np.random.default_rng(seed)
    model = {"W": r.normal(0, 0.2, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, GATE)),
             "U": r.normal(0, 0.3, (HIDDEN, GATE)), "w": r.normal(0, 0.3, GATE), "c": r.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
             "mean": np.zeros(FEATURES), "scale": np.ones(FEATURES)}
    if not len(y):
        return model
    model["mean"], model["scale"] = x.mean(axis=0), x.std(axis=0) + 0.02
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    names = ("W", "b", "V", "U", "w", "c", "d")
    first, second = ({k: np.zeros_like(model[k]) for k in names} for _ in range(2))
    starts, step = np.cumsum(counts) - counts, 0
    for epoch in range(epochs):
        order = r.permutation(len(y))
        lr = rate * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        for at in range(0, len(order), 64):
            bags = order[at:at + 64]
            size = counts[bags]
            rows = np.repeat(starts[bags] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out = forward(model, x[rows], size)
            error = (1 / (1 + np.exp(-np.clip(out["logit"], -30, 30))) - y[bags]) * balance[bags] / len(bags)
            grad = {"c": out["z"].T @ error, "d": np.array([error.sum()])}
            to_z = np.repeat(error, size)[:, None] * model["c"]
            to_a = out["a"] * (np.einsum("ij,ij->i", to_z, out["h"]) - np.repeat(error * (out["z"] @ model["c"]), size))
            grad["w"] = (out["t"] * out["g"]).T @ to_a
            to_t = to_a[:, None] * model["w"] * out["g"] * (1 - out["t"] ** 2)
            to_g = to_a[:, None] * model["w"] * out["t"] * out["g"] * (1 - out["g"])
            grad["V"], grad["U"] = out["h"].T @ to_t, out["h"].T @ to_g
            to_h = (out["a"][:, None] * to_z + to_t @ model["V"].T + to_g @ model["U"].T) * (1 - out["h"] ** 2)
            grad["W"], grad["b"] = out["x"].T @ to_h + decay * model["W"], to_h.sum(axis=0)
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                model[k] = model[k] - lr * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", column: str = "quality",
        parts: int = 4, held_out: int = 2) -> dict:
    """Model as plain arrays, from at most 2 * FIT_ROWS labelled rows; labels of held-out rows aren't read.

    With one class only, or none, every text gets that class's score, or 0.5. The intercept is moved half the way back from
    balanced classes to the shares of the labelled rows.
    """
    small_batches(docs.sparkSession)
    sample = training_rows(labels, column, parts, held_out, FIT_ROWS, id_col)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(sample), "id").select("text", "label")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, counts = encode(texts(batch, "text"))
        ends = np.cumsum(counts)
        blobs = [x[e - n:e].astype("<f4").tobytes() for e, n in zip(ends.tolist(), counts.tolist())]
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(blobs, pa.binary())], ["label", "bag"])
    found = map_texts(widen(rows.withColumn("text", text_of())), "text", run, "label int, bag binary").collect()
    found.sort(key=lambda r: (r["label"], bytes(r["bag"])))  # the order in which tasks end must not matter
    bags = [np.frombuffer(r["bag"], "<f4").reshape(-1, FEATURES) for r in found]
    y = np.array([r["label"] for r in found], float)
    x = np.vstack(bags).astype(float) if bags else np.empty((0, FEATURES))
    both = 0 < y.sum() < len(y)
    model = train(x, np.array([len(b) for b in bags], np.int64), y if both else y[:0])
    share = labels.where(F.col(column).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % parts != held_out)).agg(F.avg(column)).first()[0]
    prior = 0.5 if share is None else min(0.99, max(0.01, float(share)))
    if both:
        model["d"] = model["d"] + math.log(prior / (1 - prior)) / 2
    else:
        model["c"], model["d"] = model["c"] * 0, np.array([math.log(prior / (1 - prior))])
    return model


def score_passages(model: dict, items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text, attention of each passage, and the number of passages."""
    x, counts = encode(items)
    out = forward(model, x, counts)
    return 1 / (1 + np.exp(-np.clip(out["logit"], -30, 30))), out["a"], counts


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", column: str = "quality",
          parts: int = 4, held_out: int = 2) -> DataFrame:
    """`id_col`, held_out, score, predicted, n_passages, focus (the passage with most attention) of every row.

    Every passage of every text is encoded; ids, languages, sources and labels are never features. Null and
    empty texts are one empty passage; repeated rows repeat; a row without an id isn't held out; an
    empty table gives an empty result. Map-only once the model is fitted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, column, parts, held_out))
    rows = widen(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).withColumn("text", text_of())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, attention, counts = score_passages(shared.value, texts(batch, "text"))
        starts = np.cumsum(counts) - counts
        focus = [int(attention[s:s + n].argmax()) for s, n in zip(starts.tolist(), counts.tolist())]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores), pa.array(counts, pa.int32()), pa.array(focus, pa.int32())],
                                          ["id", "score", "n_passages", "focus"])
    kind = docs.schema[id_col].dataType.simpleString()
    made = map_texts(rows, "text", run, f"id {kind}, score double, n_passages int, focus int")
    return made.select(F.col("id").alias(id_col), F.coalesce(F.crc32(F.col("id").cast("string")) % parts == held_out, F.lit(False)).alias("held_out"),
                       "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "focus")
