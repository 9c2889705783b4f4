"""Toxicity by weak supervision.

Lexicons are induced from training labels (words and word beginnings that toxic rows have far more often)
and joined with a general word list; slices of them and patterns over their hits are voters. A generative
label model, fitted by expectation maximisation on the votes of all documents, estimates how often
each voter fires for toxic and for other texts and how voters are correlated beyond that; correlated
voters share their weight. A linear classifier on hit counts and rates is trained on its posteriors.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, releasing, slices, small_batches, store, text_of, texts, widen

# A general list of insults that needs no labels.
INSULTS = ("bastard", "clown", "cretin", "degenerate", "disgusting", "dumbass", "filth", "freak", "garbage", "idiot",
           "imbecile", "loser", "lowlife", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")

# Labelled training rows of each class that the lexicon and the voters' first rates are taken from, at most.
SAMPLE_ROWS = 10_000
# Entries that are looked at in context, and entries of the induced lexicon, at most; the strongest are taken.
CANDIDATES = 4000
LEXICON = 600
# Evidence (likelihood ratio) and rate against clean text that an entry needs, over a million candidates by chance.
EVIDENCE = 38.0
LIFT = 10.0
# Documents that the linear classifier is trained on, at most per vote pattern class (hit or no hit).
FIT_ROWS = 20_000
PREFIXES = (6, 5, 4)
SLICES = 8
VOTERS = SLICES + 6
FEATURES = 8 + SLICES
THRESHOLD = 0.7
# Words whose lexicon entry a worker remembers.
CACHE_WORDS = 500_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‚‘’…–—¿¡"


def split(text: str) -> list[str]:
    return text.lower().split()


def entries_of(word: str) -> list[str]:
    """Lexicon keys that a word can match, the most specific first: itself, then its beginnings."""
    word = word.strip(_EDGE)
    if not word:
        return []
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def bucket(doc_id, parts: int = 3) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def training_rows(labels: DataFrame, column: str, parts: int, held_out: int, rows: int, id_col: str = "doc_id") -> DataFrame:
    """A bounded sample (id, label) of the labelled rows that aren't held out: about `rows` per class.

    The ids with the lowest hashes are taken. Rows without id or label are left out.
    """
    kept = labels.where(F.col(column).isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % parts != held_out))
    kept = kept.groupBy(F.col(id_col).alias("id")).agg(F.max(column).cast("int").alias("label"))
    taken = [kept.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    return store(taken[0].union(taken[1]), "labelled")


def induce(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> tuple[dict[str, int], float]:
    """Lexicon entry -> slice, and the share of toxic rows in the sample.

    Entries are first counted by rows. The strongest are counted again by distinct words before them, so that
    a word of one text with many copies counts once, and kept if their evidence and lift suffice.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(sample), "id").select("text", "label")
    rows = rows.withColumn("text", text_of())

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, list[int]] = {}
        known: dict[str, list[str]] = {}
        for text, label in zip(texts(batch, "text"), batch.column("label").to_pylist()):
            mine: set[str] = set()
            for word in set(split(text)):
                if word not in known:
                    known[word] = entries_of(word)
                mine.update(known[word])
            for entry in mine:
                found.setdefault(entry, [0, 0])[label] += 1
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()),
             pa.array([v[1] for v in found.values()], pa.int64())], ["entry", "clean", "toxic"])
    counts = map_texts(widen(rows), "text", count, "entry string, clean bigint, toxic bigint")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1 or not n0:
        return {}, n1 / max(1, n0 + n1)
    sums = counts.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    base = n1 / (n0 + n1)
    lift = (F.col("toxic") / n1) / ((F.col("clean") + 0.5) / n0)
    strong = sums.where((_evidence(base) >= EVIDENCE) & (lift >= LIFT / 2)).orderBy(F.desc(_evidence(base)), "entry").limit(CANDIDATES)
    names = [r["entry"] for r in strong.select("entry").collect()]
    if not names:
        return {}, base
    known = docs.sparkSession.sparkContext.broadcast(frozenset(names))

    def contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple[str, str], list[int]] = {}
        for text, label in zip(texts(batch, "text"), batch.column("label").to_pylist()):
            words = split(text)
            for before, word in zip(["", *words], words):
                for entry in entries_of(word):
                    if entry in known.value:
                        found.setdefault((entry, before.strip(_EDGE)), [0, 0])[label] = 1
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
             pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())],
            ["entry", "before", "clean", "toxic"])
    pairs = map_texts(widen(rows), "text", contexts, "entry string, before string, clean bigint, toxic bigint")
    pairs = pairs.groupBy("entry", "before").agg(F.max("clean").alias("clean"), F.max("toxic").alias("toxic"))
    sums = pairs.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = sums.where((_evidence(base) >= EVIDENCE) & (lift >= LIFT)).orderBy(F.desc(_evidence(base)), "entry").limit(LEXICON)
    return {r["entry"]: k % SLICES for k, r in enumerate(best.select("entry").collect())}, base


def _evidence(base: float):
    """Twice the log likelihood ratio of the toxic share among an entry's uses against the base share; 0 if it is lower."""
    toxic, clean = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = toxic / (toxic + clean)
    gain = toxic * F.log(share / base) + F.when(clean > 0, clean * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return F.when((toxic > 0) & (share > base), 2 * gain).otherwise(0.0)


class _Matches(dict):
    """Raw word -> 1 + slice of its lexicon entry, 1 + SLICES for a word of the general list, 0 for none."""

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        keys = entries_of(word)
        found = next((1 + self.lexicon[k] for k in keys if k in self.lexicon), 0)
        if not found and keys and keys[0] in INSULTS:
            found = 1 + SLICES
        self[word] = found
        return found


def _state(shared: dict) -> _Matches:
    if "matches" not in shared:
        shared["matches"] = _Matches(shared["lexicon"])
    return shared["matches"]


def measure(matches: _Matches, text: str) -> tuple[int, np.ndarray]:
    """Votes as a bit mask, and the features of the linear classifier."""
    words = split(text)
    codes = np.fromiter(map(matches.__getitem__, words), np.int64, len(words))
    where = np.flatnonzero(codes)
    per = np.bincount(codes[where], minlength=SLICES + 2)[1:]
    hits, n = len(where), len(words)
    distinct = len({words[i].strip(_EDGE) for i in where.tolist()})
    rate = hits / n if n else 0.0
    close = int((np.diff(where) <= 15).sum()) if hits > 1 else 0
    flags = [*(per[:SLICES] > 0), per[SLICES] > 0, hits >= 2, distinct >= 2, rate > 0.002, rate > 0.01, close > 0]
    mask = sum(1 << k for k, flag in enumerate(flags) if flag)
    features = [hits > 0, hits > 1, math.log1p(hits), math.log1p(distinct), math.log1p(1000 * rate), math.log1p(close),
                math.log1p(per[SLICES]), math.log1p(n) / 10, *np.log1p(per[:SLICES])]
    return mask, np.array(features, np.float32)


def vote_table(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """id, mask, features of every row: map-only."""
    rows = widen(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).withColumn("text", text_of())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [measure(_state(shared.value), t) for t in texts(batch, "text")]
        flat = np.concatenate([f for _, f in made])
        offsets = np.arange(0, len(flat) + 1, FEATURES, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([m for m, _ in made], pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float32()))], ["id", "mask", "features"])
    return map_texts(rows, "text", run, f"id {docs.schema[id_col].dataType.simpleString()}, mask bigint, features array<float>")


def _bit(k: int):
    return F.shiftright("mask", k).bitwiseAND(F.lit(1)).cast("double")


def _posterior(model: dict):
    """Probability of the toxic class under the label model, as a column over `mask`."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for k, (t, c, w) in enumerate(zip(model["toxic"], model["clean"], model["weight"])):
        odds = odds + F.when(_bit(k) > 0, F.lit(w * math.log(t / c))).otherwise(F.lit(w * math.log((1 - t) / (1 - c))))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), odds))))


def label_model(votes: DataFrame, prior: float, rounds: int = 6) -> dict:
    """Rates of each voter in either class, prior, and weights that correlated voters share.

    `votes` has mask and n: how many documents voted so. Rates start from where most voters agree; every
    round is one aggregate over vote patterns. Correlations are those left within a class: a
    voter's weight is one over one plus its positive correlations, averaged over the classes.
    """
    fired = sum((_bit(k) for k in range(VOTERS)), F.lit(0.0))
    model = {"prior": min(0.5, max(0.01, prior)), "toxic": [0.3] * VOTERS, "clean": [0.003] * VOTERS, "weight": [1.0 / VOTERS * 3] * VOTERS}
    pairs = [(i, j) for i in range(VOTERS) for j in range(i, VOTERS)]
    for turn in range(rounds):
        p = F.when(fired >= 2, 0.95).otherwise(F.when(fired >= 1, 0.5).otherwise(0.01)) if turn == 0 else _posterior(model)
        weighed = votes.withColumn("t", F.col("n") * p).withColumn("c", F.col("n") * (1 - p))
        sums = weighed.agg(F.sum("t"), F.sum("c"), *[F.sum(F.col(y) * _bit(i) * _bit(j)) for y in ("t", "c") for i, j in pairs]).first()
        if sums[0] is None:
            return model
        sizes = [max(sums[0], 1e-9), max(sums[1], 1e-9)]
        shared = np.zeros((2, VOTERS, VOTERS))
        for k, (i, j) in enumerate(pairs):
            for y in (0, 1):
                shared[y, i, j] = shared[y, j, i] = sums[2 + y * len(pairs) + k] or 0.0
        rates = np.array([(np.diag(shared[y]) + (0.3, 0.003)[y]) / (sizes[y] + 1) for y in (0, 1)])
        correlation = np.zeros((VOTERS, VOTERS))
        for y in (0, 1):
            joint = (shared[y] + 1e-9) / (sizes[y] + 1)
            deviation = np.sqrt(rates[y] * (1 - rates[y])) + 1e-9
            correlation += np.clip((joint - np.outer(rates[y], rates[y])) / np.outer(deviation, deviation), 0, 1) * (sizes[y] > 1) / 2
        np.fill_diagonal(correlation, 0)
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        model = {"prior": float(np.clip(sizes[0] / sum(sizes), 1e-4, 0.5)), "toxic": rates[0].tolist(), "clean": rates[1].tolist(),
                 "weight": (1 / (1 + correlation.sum(axis=1))).tolist()}
    return model


def linear_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 3, held_out: int = 1) -> tuple[dict, DataFrame]:
    """The fitted model as plain values, and the stored vote table of `docs` that it was fitted on.

    Labels of rows with crc32(id) mod `parts` = `held_out` aren't read. Without labels or without toxic ones
    the general word list alone votes. At most 2 * SAMPLE_ROWS labelled rows choose the lexicon, and
    at most 2 * FIT_ROWS documents train the classifier; the label model sees all documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = training_rows(labels, "toxic", parts, held_out, SAMPLE_ROWS)
    lexicon, prior = induce(docs, sample, id_col, text_col)
    shared = spark.sparkContext.broadcast({"lexicon": lexicon})
    votes = store(vote_table(docs, shared, id_col, text_col), "votes")
    patterns = store(votes.groupBy("mask").agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    model = label_model(patterns, prior)
    taken = votes.withColumn("p", _posterior(model)).select("features", "p", (F.col("mask") != 0).alias("hit"), F.xxhash64("id", "mask").alias("h"))
    found = taken.where("hit").orderBy("h").limit(FIT_ROWS).union(taken.where("not hit").orderBy("h").limit(FIT_ROWS)).toPandas()
    sizes = {r["hit"]: r["n"] for r in patterns.groupBy((F.col("mask") != 0).alias("hit")).agg(F.sum("n").alias("n")).collect()}
    if len(found):
        weight = np.array([sizes[h] / max(1, (found["hit"] == h).sum()) for h in found["hit"]], float)
        beta = linear_fit(np.vstack(found["features"]).astype(float), found["p"].to_numpy(float), weight * len(found) / weight.sum())
    else:
        beta = np.zeros(FEATURES + 1)
    return {"lexicon": lexicon, "labels": model, "beta": beta.tolist()}, votes


def score_column(model: dict, features: str = "features"):
    """The score over a column of features: JVM-side."""
    beta = model["beta"]
    total = F.lit(float(beta[-1]))
    for k in range(FEATURES):
        total = total + F.element_at(features, k + 1).cast("double") * F.lit(float(beta[k]))
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 3, held_out: int = 1) -> DataFrame:
    """`id_col`, held_out, score, predicted of every row; features that don't hold an id, language, source or label.

    Null and empty texts get the score of a text without hits; repeated rows repeat; a row without an id is
    scored and counts as not held out. An empty table gives an empty result.
    """
    model, votes = fit(docs, labels, id_col, text_col, parts, held_out)
    out = votes.select(F.col("id").alias(id_col), F.coalesce(F.crc32(F.col("id").cast("string")) % parts == held_out, F.lit(False)).alias("held_out"),
                       score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score below THRESHOLD, with all their columns, by one more pass over the texts.

    Rows are judged in the scan, so neither ids nor texts are shuffled, and repeated ids do no harm.
    """
    model, _ = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast({"lexicon": model["lexicon"], "beta": model["beta"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta = np.array(shared.value["beta"])
        for batch in batches:
            for part in slices(batch, text_col):
                x = np.vstack([measure(_state(shared.value), t)[1] for t in texts(part, text_col)]).astype(float)
                s = 1 / (1 + np.exp(-(x @ beta[:-1] + beta[-1])))
                yield part.filter(pa.array(s < THRESHOLD))
    return widen(docs).mapInArrow(releasing(run), docs.schema)
