"""Byte-level BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of every new word. A proposal is the true encoding exactly
if each token encodes to itself and each adjacent pair is compatible: merging the two tokens' bytes
from scratch would never join across their border. That test walks the merge trees of all pairs at
once in NumPy. Only words with an incompatible pair are merged rank by rank.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, small_batches, texts, text_of, widen

# The split pattern of the vocabulary's library, and Unicode's White_Space characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# Chunks that a worker remembers; at this number it starts anew.
CACHE_WORDS = 500_000

# Bytes of text that are cut into chunks at a time.
TEXT_BYTES = 1 << 20


def _byte_of_char() -> dict[str, int]:
    """Byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves,
    the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return table


def load(path: str) -> dict:
    """Model of a byte-level BPE file of the tokenizers library, as plain arrays that can be broadcast."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte = _byte_of_char()
    vocab = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = 1 + max([*vocab.values(), *special.values()])
    tokens = [b""] * size
    for word, i in vocab.items():
        tokens[i] = word
    for word, i in special.items():
        tokens[i] = word.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    pairs = [(bytes(byte[c] for c in a), bytes(byte[c] for c in b)) for a, b in pairs]
    born, left, right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for rank, (a, b) in enumerate(pairs):
        i = vocab[a + b]
        if born[i] < 0:
            born[i], left[i], right[i] = rank, vocab[a], vocab[b]
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    model = {"tokens": tokens, "special": special, "size": size, "born": born, "left": left, "right": right,
             "keys": keys[order], "ranks": order.astype(np.int64),
             "results": np.array([vocab[a + b] for a, b in pairs], np.int64)[order]}
    own = [i for i in vocab.values() if _merge(model, tokens[i]) == [i]]
    model["own"] = np.array(sorted(own), np.int64)
    return model


def _prepare(model: dict) -> dict:
    """Lookup tables of a worker, made once and kept on the broadcast value."""
    if "match" not in model:
        tokens = model["tokens"]
        model["match"] = {tokens[i]: i for i in model["own"].tolist()}
        model["longest"] = max(map(len, model["match"]))
        model["merges"] = {int(k): (int(r), int(t)) for k, r, t in zip(model["keys"], model["ranks"], model["results"])}
        model["single"] = [0] * 256
        for i, token in enumerate(tokens):
            if len(token) == 1 and token.decode("latin-1") not in model["special"]:
                model["single"][token[0]] = i
    return model


def _merge(model: dict, word: bytes) -> list[int]:
    """Exact encoding: join the adjacent pair of lowest rank, the leftmost first, until none is left."""
    if "merges" not in model:
        model["merges"] = {int(k): (int(r), int(t)) for k, r, t in zip(model["keys"], model["ranks"], model["results"])}
        model["single"] = [0] * 256
        for i, token in enumerate(model["tokens"]):
            if len(token) == 1:
                model["single"][token[0]] = i
    merges, size = model["merges"], model["size"]
    ids = [model["single"][b] for b in word]
    if len(ids) > 200:
        return _merge_long(merges, size, ids)
    never = (1 << 60, -1)
    found = [merges.get(a * size + b, never) for a, b in zip(ids, ids[1:])]
    while found:
        best = min(found)
        if best is never:
            break
        at = found.index(best)
        ids[at:at + 2] = [best[1]]
        del found[at]
        if at:
            found[at - 1] = merges.get(ids[at - 1] * size + best[1], never)
        if at < len(found):
            found[at] = merges.get(best[1] * size + ids[at + 1], never)
    return ids


def _merge_long(merges: dict, size: int, ids: list[int]) -> list[int]:
    """The same for long words with a heap, in n log n steps."""
    import heapq
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get(ids[i] * size + ids[i + 1]))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, joined = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = joined, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if m := merges.get(joined * size + ids[after[i]]):
                heapq.heappush(heap, (m[0], i, joined, ids[after[i]], m[1]))
        if before[i] >= 0:
            p = before[i]
            if m := merges.get(ids[p] * size + joined):
                heapq.heappush(heap, (m[0], p, ids[p], joined, m[1]))
    return [t for t, live in zip(ids, alive) if live]


def compatible(model: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the bytes of each pair of tokens gives just those two tokens.

    The pieces at the border are undone in reverse order of birth. At each stage the two pieces
    exist together until the younger one's parent was born; a merge of both with a lower rank would
    have come first. At equal rank the left pair wins, so only a parent on the right side loses.
    """
    size, born, left, right, keys, ranks = (model[k] for k in ("size", "born", "left", "right", "keys", "ranks"))
    good = np.ones(len(a), bool)
    x, y, row = a.astype(np.int64), b.astype(np.int64), np.arange(len(a))
    until = np.full(len(a), 2 * len(ranks) + 2, np.int64)  # twice the rank, plus one if a tie joins across
    while len(row):
        key = x * size + y
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        joined = (keys[at] == key) & (2 * ranks[at] < until)
        good[row[joined]] = False
        young = np.maximum(born[x], born[y])
        live = ~joined & (young >= 0)
        x, y, row = x[live], y[live], row[live]
        on_left = born[x] > born[y]
        until = np.where(on_left, 2 * born[x], 2 * born[y] + 1)
        x, y = np.where(on_left, right[x], x), np.where(on_left, y, left[y])
    return good


def _greedy(model: dict, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Longest matches from left to right: the ids of all words in a row, and the count of each."""
    match, longest = model["match"].get, model["longest"]
    ids: list[int] = []
    counts: list[int] = []
    for word in words:
        i, n, before = 0, len(word), len(ids)
        while i < n:
            j = min(n, i + longest)
            while (found := match(word[i:j])) is None:
                j -= 1
            ids.append(found)
            i = j
        counts.append(len(ids) - before)
    return np.array(ids, np.int64), np.array(counts, np.int64)


def encode_words(model: dict, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of pre-split words: one flat array, and the count of each word."""
    _prepare(model)
    ids, counts = _greedy(model, words)
    if len(ids) < 2:
        return ids, counts
    word_of = np.repeat(np.arange(len(words)), counts)
    inner = np.flatnonzero(word_of[1:] == word_of[:-1])
    pairs, where = np.unique(ids[inner] * model["size"] + ids[inner + 1], return_inverse=True)
    good = compatible(model, pairs // model["size"], pairs % model["size"])
    failed = np.unique(word_of[inner[~good[where]]])
    if len(failed):
        parts, starts = [], np.concatenate([[0], np.cumsum(counts)])
        last = 0
        for w in failed.tolist():
            exact = _merge(model, words[w])
            parts += [ids[last:starts[w]], np.array(exact, np.int64)]
            last = starts[w + 1]
            counts[w] = len(exact)
        ids = np.concatenate([*parts, ids[last:]])
    return ids, counts


def _split_patterns(model: dict):
    if "chunk" not in model:
        import re

        import regex
        model["chunk"] = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        model["split"] = regex.compile(SPLIT)
        names = sorted(model["special"], key=len, reverse=True)
        model["cut"] = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
    return model["chunk"], model["split"], model["cut"]


class _Numbers(dict):
    """Chunks numbered in order of appearance; new ones are collected."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number


class Encoder:
    """Encodes texts in bulk. Chunks of white space and the word after it are split and encoded once
    and remembered; a text's split never depends on what lies beyond such a chunk."""

    def __init__(self, model: dict):
        self.model = _prepare(model)
        self.chunk, self.split, self.cut = _split_patterns(model)
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.lens = np.empty(0, np.int32), np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)

    def _words(self, chunk: str) -> Iterator[str]:
        if self.cut is None:
            yield from self.split.findall(chunk)
            return
        for i, part in enumerate(self.cut.split(chunk)):
            if i % 2:
                yield part
            else:
                yield from self.split.findall(part)

    def _learn(self, chunks: list[str]) -> None:
        special = self.model["special"]
        words = _Numbers()
        flat: list[int] = []
        sizes: list[int] = []
        for chunk in chunks:
            mine = [words[w] for w in self._words(chunk)]
            flat += mine
            sizes.append(len(mine))
        ids, counts = encode_words(self.model, [b"" if w in special else w.encode() for w in words.new])
        if special and any(w in special for w in words.new):
            starts = np.concatenate([[0], np.cumsum(counts)])
            listed = [np.array([special[w]]) if w in special else ids[starts[i]:starts[i + 1]]
                      for i, w in enumerate(words.new)]
            ids, counts = np.concatenate(listed), np.array([len(x) for x in listed], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        word = np.array(flat, np.int64)
        of_chunk = np.add.reduceat(np.append(counts[word], 0), np.minimum(np.cumsum([0, *sizes[:-1]]), len(word)))
        of_chunk[np.array(sizes) == 0] = 0
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(of_chunk) - of_chunk])
        self.ids = np.concatenate([self.ids, ids[_ranges(starts[word], counts[word])].astype(np.int32)])
        self.lens = np.concatenate([self.lens, of_chunk])

    def encode(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the count of each text."""
        if len(self.numbers) > CACHE_WORDS:
            self._clear()
        found: list[str] = []
        ends: list[int] = []
        for text in items:
            found += self.chunk.findall(text)
            ends.append(len(found))
        number = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        if self.numbers.new:
            self._learn(self.numbers.new)
            self.numbers.new = []
        lens = self.lens[number]
        total = np.concatenate([[0], np.cumsum(lens)])
        bounds = total[np.array([0, *ends])]
        return self.ids[_ranges(self.starts[number], lens)], np.diff(bounds)


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + len), one after the other."""
    total = int(lens.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(total)


def decode(model: dict, ids: np.ndarray) -> str:
    """Text of the ids; bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(model["tokens"].__getitem__, ids.tolist())).decode("utf-8", "replace")


def encoder_of(model: dict) -> Encoder:
    """The worker's encoder for a broadcast model; it lives as long as the worker keeps the model."""
    if "encoder" not in model:
        model["encoder"] = Encoder(model)
    return model["encoder"]


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text.

    Returns `id_col`, ids array<int>. Null and empty texts give an empty array; repeated rows give repeated
    results; a null id stays null; other columns aren't read. Map-only: no row moves unless the table
    is one unsplittable file. Memory: a slice of texts, one Arrow batch and the word cache.
    """
    model, rows = _broadcast(docs, path, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encoder_of(model.value).encode(texts(batch, "text"))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], [id_col, "ids"])
    return map_texts(rows, "text", run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>", TEXT_BYTES)


def decode_table(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Text of every array of ids: `id_col`, text. A null array gives the empty text; an unknown id fails."""
    model = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode(model.value, np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.string())], [id_col, "text"])
    return encoded.select(id_col, "ids").mapInArrow(
        run, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, summary: Callable[[np.ndarray, str], Iterable], schema: str,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode its ids in one pass; `summary(ids, decoded)` gives further columns.

    `schema` names them ("n bigint, hash string"). Same rules for nulls and repeats as `encode_table`.
    """
    model, rows = _broadcast(docs, path, id_col, text_col)
    names = [part.split()[0] for part in schema.split(",")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encoder_of(model.value).encode(texts(batch, "text"))
        out, start = [], 0
        for count in counts.tolist():
            mine = ids[start:start + count]
            out.append(tuple(summary(mine, decode(model.value, mine))))
            start += count
        columns = [pa.array(c) for c in zip(*out)]
        return pa.RecordBatch.from_arrays([batch.column("id"), *columns], [id_col, *names])
    return map_texts(rows, "text", run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {schema}", TEXT_BYTES)


def _broadcast(docs: DataFrame, path: str, id_col: str, text_col: str):
    small_batches(docs.sparkSession)
    rows = widen(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    return docs.sparkSession.sparkContext.broadcast(load(path)), rows.withColumn("text", text_of())


def digest(ids: np.ndarray, decoded: str) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())
