"""Language of words by a linear-chain conditional random field.

Each word has affix, n-gram and lexicon features; neighbouring words are tied by learned transitions, and
forward-backward gives the probability of every language at every word, also where a text switches language.
A document's language is the one that most of its letters have. Only documents have labels, so the
field is trained on runs of words of labelled documents, each of them once alone and once continued by a
run of another language, which teaches the transitions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches, text_of, texts, widen

# Training sample: labelled rows of each language, at most, and consecutive words of each row, at most.
FIT_ROWS, FIT_WORDS = 400, 128
# A word belongs to the lexicon when so many sampled rows hold it.
LEXICON_ROWS = 3
BITS = 17
# Words that a task remembers; then it starts anew.
WORDS = 300_000
SEGMENT = 32
LARGEST = 30.0
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, family: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + np.uint64(family * 2 + 1)) * _PRIME
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def describe(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of distinct words as (word, bucket, value) triples, and a hash of each word.

    Prefixes of up to three and suffixes of up to four letters, all two- and three-letter runs (together
    one unit of weight), and the word itself if the sorted `lexicon` has its hash. Case is ignored.
    """
    lowered = [w.lower() for w in words]
    size = np.array([len(w) for w in lowered], np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), "<u4").astype(np.uint64)
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    left = np.repeat(first + size, size) - np.arange(len(codes))  # letters from here to the word's end
    at, out = np.arange(len(codes)) - np.repeat(first, size), []
    with np.errstate(over="ignore"):
        grams = {1: codes}
        for n in range(2, 5):
            grams[n] = grams[n - 1][:max(0, len(codes) - n + 1)] * np.uint64(1_000_003) + codes[n - 1:]
        for n in (1, 2, 3):
            here = np.flatnonzero((at == 0) & (left >= n))
            out.append((of[here], _bucket(grams[n][here], n), np.ones(len(here))))
        for n in (1, 2, 3, 4):
            here = np.flatnonzero((left == n) & (left + at >= n))
            out.append((of[here], _bucket(grams[n][here], 10 + n), np.ones(len(here))))
        for n in (2, 3):
            here = np.flatnonzero(left >= n)
            out.append((of[here], _bucket(grams[n][here], 20 + n), 1 / np.sqrt(np.maximum(1, size[of[here]] - n + 1))))
        power = np.full(int(size.max(initial=0)) + 1, np.uint64(1_099_511_628_211), np.uint64)
        power[:1] = 1
        power = np.cumprod(power, dtype=np.uint64)
        whole = np.add.reduceat(codes * power[at], first) * _PRIME + size.astype(np.uint64) if len(words) else np.empty(0, np.uint64)
    known = np.flatnonzero(np.isin(whole, lexicon))
    out.append((known, _bucket(whole[known], 30), np.ones(len(known))))
    return *(np.concatenate(x) for x in zip(*out)), whole


def emissions(weights: np.ndarray, triples: tuple, count: int) -> np.ndarray:
    """Score of every label at every word."""
    word, bucket, value = triples
    return np.stack([np.bincount(word, weights[bucket, k] * value, count) for k in range(weights.shape[1])], axis=1)


def marginals(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, float, np.ndarray]:
    """Probability of each label at each word, the log of all sequences' normalisers, and expected label pairs.

    Forward-backward over all sequences at once: each is cut into segments of SEGMENT words, whose transfer
    matrices are multiplied side by side; messages then pass from segment to segment, and into all
    segments side by side. Scores of one word that lie over LARGEST below its best count as that far below.
    """
    n, k = scores.shape
    tops = scores.max(axis=1, initial=-np.inf)
    e = np.exp(np.maximum(scores - tops[:, None], -LARGEST))
    peak = transitions.max()
    move = np.exp(np.maximum(transitions - peak, -LARGEST))
    segs = -(-counts // SEGMENT)
    total = int(segs.sum())
    seq = np.repeat(np.arange(len(counts)), segs)
    number = np.arange(total) - np.repeat(np.cumsum(segs) - segs, segs)
    start = (np.cumsum(counts) - counts)[seq] + number * SEGMENT
    size = np.minimum(SEGMENT, counts[seq] - number * SEGMENT)
    padded = np.ones((total, SEGMENT, k))
    inside = np.arange(SEGMENT) < size[:, None]
    rows = (start[:, None] + np.arange(SEGMENT))[inside]
    padded[inside] = e[rows]
    head = number == 0  # the first word of a sequence has no transition before it

    def step(m: np.ndarray, t: int) -> np.ndarray:
        """Rows of messages (segments, r, labels) moved on to word t; over the end they stay."""
        moved = m @ move if t else np.where(head[:, None, None], m, m @ move)
        return np.where(inside[:, t][:, None, None], moved * padded[:, t][:, None, :], m)
    transfer = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(SEGMENT):
        transfer = step(transfer, t)
        transfer /= transfer.sum(axis=(1, 2), keepdims=True)
    before, after = np.full((total, k), 1 / k), np.full((total, k), 1 / k)
    by_number = np.argsort(number, kind="stable")
    edges = np.searchsorted(number[by_number], np.arange(int(segs.max(initial=0)) + 1))
    for j in range(1, len(edges) - 1):
        here = by_number[edges[j]:edges[j + 1]]
        m = np.einsum("si,sij->sj", before[here - 1], transfer[here - 1])
        before[here] = m / m.sum(axis=1, keepdims=True)
        later = by_number[edges[len(edges) - 1 - j]:edges[len(edges) - j]]
        m = np.einsum("sij,sj->si", transfer[later], after[later])
        after[later - 1] = m / m.sum(axis=1, keepdims=True)
    # with the messages at their ends, all segments run side by side
    forward, log_z, m = np.empty((total, SEGMENT, k)), 0.0, before[:, None, :]
    for t in range(SEGMENT):
        moved = step(m, t)
        scale = moved.sum(axis=2, keepdims=True)
        log_z += np.log(scale).sum()
        m = moved / scale
        forward[:, t] = m[:, 0]
    log_z += tops.sum() + peak * np.maximum(counts - 1, 0).sum() + math.log(k) * (counts > 0).sum()
    found, expected, b = np.empty((total, SEGMENT, k)), np.zeros((k, k)), after
    for t in range(SEGMENT - 1, -1, -1):
        p = forward[:, t] * b
        found[:, t] = p / p.sum(axis=1, keepdims=True)
        came = padded[:, t] * b
        if pairs:
            prev = forward[:, t - 1] if t else before
            live = inside[:, t] & ~(head & (t == 0))
            x = prev[live][:, :, None] * move * came[live][:, None, :]
            expected += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = came @ move.T
        b = np.where(inside[:, t][:, None], back / back.sum(axis=1, keepdims=True), b)
    out = np.empty((n, k))
    out[rows] = found[inside]
    return out, float(log_z), expected


def train(runs: list[list[str]], labels: np.ndarray, count: int, epochs: int = 50, rate: float = 0.3, decay: float = 1e-5, seed: int = 7) -> dict:
    """Weights, transitions and lexicon from runs of words and their labels, by Adagrad on the whole sample."""
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w.lower() for run in runs for w in run))}
    words = list(vocabulary)
    coded = [np.array([vocabulary[w.lower()] for w in run], np.int64) for run in runs]
    held = np.bincount(np.concatenate([np.unique(c) for c in coded]) if coded else np.empty(0, np.int64), minlength=len(words))
    *_, hashes = describe(words, np.empty(0, np.uint64))
    lexicon = np.unique(hashes[held >= LEXICON_ROWS])
    word, bucket, value, _ = describe(words, lexicon)
    used, place = np.unique(bucket, return_inverse=True)
    r = np.random.default_rng(seed)
    pieces, marks, sizes = [], [], []

    def add(parts):
        pieces.extend(c for c, _ in parts)
        marks.extend(np.full(len(c), y) for c, y in parts)
        sizes.append(sum(len(c) for c, _ in parts))
    for i, c in enumerate(coded):
        add([(c, labels[i])])
        others = np.flatnonzero(labels != labels[i])
        if len(others):
            j = int(r.choice(others))
            add([(c[:len(c) // 2], labels[i]), (coded[j][len(coded[j]) // 2:], labels[j])])
    x, y, counts = np.concatenate(pieces), np.concatenate(marks), np.array(sizes, np.int64)
    first = np.zeros(len(x), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    gold_pairs = np.zeros((count, count))
    np.add.at(gold_pairs, (y[:-1][~first[1:]], y[1:][~first[1:]]), 1)
    # languages weigh alike
    share = np.bincount(y, minlength=count)
    weight = (len(y) / max(1, count) / np.maximum(share, 1))[y]
    w, t = np.zeros((len(used), count)), np.zeros((count, count))
    w2, t2 = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    target = np.zeros((len(x), count))
    target[np.arange(len(x)), y] = 1
    for _ in range(epochs):
        scores = emissions(w, (word, place, value), len(words))
        p, _, expected = marginals(scores[x], counts, t, pairs=True)
        gap = (target - p) * weight[:, None]
        by_word = np.stack([np.bincount(x, gap[:, k], len(words)) for k in range(count)], axis=1) / len(x)
        gw = np.stack([np.bincount(place, by_word[word, k] * value, len(used)) for k in range(count)], axis=1) - decay * w
        gt = (gold_pairs - expected) / len(x) - decay * t
        w2 += gw * gw
        t2 += gt * gt
        w += rate * gw / np.sqrt(w2)
        t += rate * gt / np.sqrt(t2)
    weights = np.zeros((1 << BITS, count), np.float32)
    weights[used] = w
    return {"weights": weights, "transitions": t, "lexicon": lexicon}


def letters(text: str) -> list[str]:
    """The words of a text: runs of letters, with the numerals and marks that word characters include."""
    return [w for w in _WORD.findall(text) if w.isalpha() or any(map(str.isalpha, w))]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held_out: int = 2,
        fit_rows: int = FIT_ROWS, fit_words: int = FIT_WORDS) -> dict:
    """Model as plain arrays, from at most `fit_rows` rows a language and `fit_words` consecutive words of each.

    Rows come in order of a hash of their id; the run of words starts at a hashed place in the text. Held-out
    rows, rows without an id, a language or a letter aren't learned from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.crc32("id") % parts != held_out)).withColumn("h", F.xxhash64("id", F.lit(13)))
    sizes = {r["lang"]: r["n"] for r in docs.where(docs[lang_col].isNotNull()).groupBy(docs[lang_col].alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {"labels": []}
    # so many rows of each language that enough of them are left beside held-out and empty ones
    wanted = 3 * fit_rows + 200
    shares = spark.createDataFrame([(k, min(1.0, wanted / n)) for k, n in sizes.items()], "lang string, share double")
    chosen = rows.join(F.broadcast(shares), "lang").where((F.col("h").cast("double") / 2.0 ** 64 + 0.5) <= F.col("share")).drop("share")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, h in zip(texts(batch, "text"), batch.column("h").to_pylist()):
            words = letters(text)
            at = (h >> 8) % max(1, len(words) - fit_words + 1)
            out.append(words[at:at + fit_words])
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(out, pa.list_(pa.string()))], ["lang", "h", "words"])
    made = map_texts(widen(chosen.select("lang", "h", "text")), "text", run, "lang string, h bigint, words array<string>")
    found = made.orderBy("h", "words").limit(2 * wanted * len(sizes)).collect()
    taken, runs = dict.fromkeys(sizes, 0), []
    for r in found:
        if taken[r["lang"]] < fit_rows and r["words"]:
            taken[r["lang"]] += 1
            runs.append((r["lang"], [w[:200] for w in r["words"]]))
    names = sorted(k for k, n in taken.items() if n)
    if not names:
        return {"labels": []}
    marks = np.array([names.index(k) for k, _ in runs], np.int64)
    return {"labels": names, **train([w for _, w in runs], marks, len(names))}


class Tagger:
    """A model with the scores of the words met so far."""

    def __init__(self, model: dict):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.empty((0, len(self.model["labels"])))
        self.length = np.empty(0, np.int64)

    def tag(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label probabilities and letters of all words of all texts in a row, and the words of each text."""
        fresh = list(dict.fromkeys(w for words in found for w in words if w not in self.index))
        if len(self.index) + len(fresh) > WORDS and self.index:
            self.forget()
            fresh = list(dict.fromkeys(w for words in found for w in words))
        if fresh:
            *triples, _ = describe(fresh, self.model["lexicon"])
            self.scores = np.vstack([self.scores, emissions(self.model["weights"], triples, len(fresh))])
            self.length = np.concatenate([self.length, [len(w) for w in fresh]])
            for w in fresh:
                self.index[w] = len(self.index)
        place = np.array([self.index[w] for words in found for w in words], np.int64)
        counts = np.array([len(words) for words in found], np.int64)
        return marginals(self.scores[place], counts, self.model["transitions"])[0], self.length[place], counts


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held_out: int = 2,
            model: dict | None = None) -> DataFrame:
    """`id_col`, held_out, lang_pred, score and n_words of every row.

    score is the share of the text's letters that the field gives to lang_pred. Texts that are null or without a letter, and
    all texts where nothing can be learned, are `und` with score 0. Repeated rows repeat; a row without an
    id isn't held out; an empty table gives an empty result. Map-only once the model is fitted.
    """
    model = model or fit(docs, id_col, text_col, lang_col, parts, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = widen(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).withColumn("text", text_of())
    kind = docs.schema[id_col].dataType.simpleString()
    tagger: list[Tagger] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = shared.value["labels"]
        if not tagger:
            tagger.append(Tagger(shared.value))
        found = [letters(t) for t in texts(batch, "text")]
        counts = [len(f) for f in found]
        langs, scores = [UNKNOWN] * len(found), np.zeros(len(found))
        if names and sum(counts):
            p, size, n = tagger[0].tag(found)
            of = np.repeat(np.arange(len(found)), n)
            mass = np.stack([np.bincount(of, p[:, k] * size, len(found)) for k in range(len(names))], axis=1)
            best, whole = mass.argmax(axis=1), mass.sum(axis=1)
            scores = np.clip(mass[np.arange(len(found)), best] / np.where(whole > 0, whole, 1), 0, 1)
            langs = [names[k] if c else UNKNOWN for k, c in zip(best.tolist(), counts)]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs), pa.array(scores), pa.array(counts, pa.int64())],
                                          ["id", "lang_pred", "score", "n_words"])
    made = map_texts(rows, "text", run, f"id {kind}, lang_pred string, score double, n_words bigint")
    return made.select(F.col("id").alias(id_col), F.coalesce(F.crc32(F.col("id").cast("string")) % parts == held_out, F.lit(False)).alias("held_out"),
                       "lang_pred", "score", "n_words")


def language_runs(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and, for every row, the runs of words of one language: character range, lang, mean probability."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = widen(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).withColumn("text", text_of())
    kind = docs.schema[id_col].dataType.simpleString()
    part = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tagger = shared.value["labels"], Tagger(shared.value) if shared.value["labels"] else None
        for batch in batches:
            for i, text in zip(batch.column(0), texts(batch, "text")):
                spans = [m.span() for m in _WORD.finditer(text) if any(map(str.isalpha, m.group()))]
                out = []
                if spans and names:
                    p, _, _ = tagger.tag([[text[a:b] for a, b in spans]])
                    label = p.argmax(axis=1)
                    cuts = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist(), len(spans)]
                    out = [{"start": spans[a][0], "end": spans[b - 1][1], "lang": names[label[a]], "score": float(p[a:b, label[a]].mean())}
                           for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], batch.schema.field(0).type), pa.array([out], pa.list_(part))], ["id", "runs"])
    made = rows.mapInArrow(run, f"id {kind}, runs array<struct<start: bigint, end: bigint, lang: string, score: double>>")
    return made.select(F.col("id").alias(id_col), "runs")
