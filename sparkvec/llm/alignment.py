"""Cross-tokenizer alignment: which tokens of a byte-level BPE and of a sentencepiece model cover the same bytes.

The spans that the libraries give with the tokens are coarse cuts: character offsets of the first, byte spans of
the second's proto. A span holds where it has as many bytes as the token decodes to and touches its
neighbours; elsewhere, in runs of tokens that share a multibyte character or came from byte fallback, the
decoded bytes refine it. Offsets where tokens of both end cut the text into groups.

Neither tokenizer joins a space to the character before it, nor a letter to the sign after it, so a text falls
into units that align by themselves: words with the space or line end before them, and what lies between.
Each distinct unit is tokenized and aligned once per task and looked up after that.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, slices, small_batches, store, text_of, texts, widen

# Units that a task remembers; then it starts anew. Characters of units that are tokenized in one text.
UNITS, CHUNK = 250_000, 1 << 15
# Bytes of text that are looked up at once: a text's units and pairs take about a hundred bytes a byte. Bytes of an Arrow batch.
PART_BYTES, BATCH_BYTES = 1 << 18, 4 << 20
# Id pairs whose counts are broadcast (17 bytes each), the most frequent ones; the others are joined by shuffle.
HEAD_PAIRS = 2_000_000
# Links of a group from which on its ids are counted before they are paired.
WIDE_GROUP = 1 << 16

# A word unit is a space or line end and Latin letters, with an ASCII sign, a digit or the text's end behind. A unit between
# words ends before a space that follows no white space, or before a word unit that does.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
_WORD = rf"{_LETTERS}+(?=[\x00-@\[-`{{-\x7f]|\Z)"
_UNIT = re.compile(rf"[ \n]{_WORD}|.+?(?=(?<=\S)(?: |\n{_WORD})|\Z)", re.S)
# Stands before a unit that doesn't start like a word, so that it meets a letter as it may in a text.
_GUARD = " a"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... of all ranges in a row."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def refine(begin: np.ndarray, end: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ends of tokens from coarse byte spans; `first` marks the first token of each unit.

    A span that has the token's length, starts where the one before ends and isn't entered by the next
    one is kept. The other tokens end where the last kept end and their decoded lengths put them.
    """
    last = np.r_[first[1:], True] if len(first) else first
    touches = begin == np.where(first, 0, np.r_[0, end[:-1]])
    free = np.where(last, True, np.r_[begin[1:], 0] == end)
    sure = (end - begin == length) & touches & free
    total = np.cumsum(length)
    # for each token: the last place at or before it where the end is known, or the unit's start
    place = np.arange(len(begin))
    known = np.maximum.accumulate(np.where(sure, place, -1))
    start = np.maximum.accumulate(np.where(first, place, -1))
    inside = known >= start
    base = np.where(inside, end[known], 0)
    passed = np.where(inside, total[known], total[start] - length[start])
    return base + total - passed


class Aligner:
    """Both tokenizers, and what is known of the units met so far."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread of the library keeps memory of its own
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_alphabet()
        vocabulary = json.loads(a_json)["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in json.loads(a_json).get("added_tokens", ()))]))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.by_units = not any(re.search(rf"[^\s▁][ ▁\n]|{_LETTERS}[\x00-@\[-`{{-\x7f]|\n{_LETTERS}", p) for p in plain)
        self.names = [np.array([f"{i}{sign}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))], object) for sign in ",|;"]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.labels: list[str] = []
        self.size = np.empty((0, 5), np.int64)  # a tokens, b tokens, groups, links, 1 if its bytes came back
        self.at = np.zeros(1, np.int64)
        self.pairs = self.times = np.empty(0, np.int64)

    def units(self, text: str) -> list[str]:
        """The units of a space and `text`."""
        return _UNIT.findall(" " + text) if self.by_units else [" " + text]

    def tokens(self, units: list[str], alone: bool = False) -> dict:
        """Ids, refined byte ends and unit of the tokens of both, for all units in a row, and which units' bytes came back.

        Units are tokenized in joined texts, or each in a text of its own: those that end in white space, that aren't cut by
        the rule, and, `alone`, all of a joined text in which bytes don't come back.
        """
        chunks, segments, room = [], [], 0  # texts; (text of a segment, its unit or -1, its chunk)
        for k, u in enumerate(units):
            own = alone or not self.by_units or u[-1].isspace()
            if own or room <= 0:
                chunks.append([])
                room = CHUNK
            word = u[0] in " \n" and u[1:].isalpha()
            if u[0] != " " or u.isspace() if own or not chunks[-1] else not word:
                chunks[-1].append(_GUARD)
                segments.append((_GUARD, -1, len(chunks) - 1))
            chunks[-1].append(u)
            segments.append((u, k, len(chunks) - 1))
            room = 0 if own else room - len(u)
        joined = ["".join(c) for c in chunks]
        raw = [x[0].encode() for x in segments]
        seg_size, seg_unit, seg_chunk = (np.array(x, np.int64) for x in ([len(r) for r in raw], [x[1] for x in segments], [x[2] for x in segments]))
        ends = np.cumsum(seg_size)
        begins = ends - seg_size
        byte0 = begins[np.flatnonzero(np.diff(seg_chunk, prepend=-1))]
        chars = np.array([len(c) for c in joined], np.int64)
        char0 = np.cumsum(chars) - chars
        whole = b"".join(raw)
        # character offsets to byte offsets: the first byte of each character of all texts in a row
        letters = np.frombuffer(whole, np.uint8)
        starts = np.r_[np.flatnonzero((letters & 0xC0) != 0x80), len(letters)]
        out, fits = {"size": np.zeros(len(units), np.int64)}, np.ones(len(segments), bool)
        real = seg_unit >= 0
        out["size"][seg_unit[real]] = seg_size[real]
        for side in "ab":
            if side == "a":
                encoded = self.a.encode_batch(joined, add_special_tokens=False)
                n = np.array([len(e) for e in encoded], np.int64)
                ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.int64, int(n.sum()))
                spans = np.fromiter(chain.from_iterable(o for e in encoded for o in e.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
                spans = starts[spans + np.repeat(char0, n)[:, None]]
                begin, end, length, decoded = spans[:, 0], spans[:, 1], self.a_len[ids], self.a_bytes
            else:
                protos = self.b.encode([c[1:] for c in joined], return_type="proto", num_threads=1)
                n = np.array([len(q.pieces) for q in protos], np.int64)
                found = np.fromiter(chain.from_iterable((p.id, p.begin, p.end) for q in protos for p in q.pieces), np.int64, 3 * int(n.sum())).reshape(-1, 3)
                at = np.repeat(byte0, n)
                ids, end = found[:, 0], found[:, 2] + at + 1  # after the space that it adds
                begin, length, decoded = np.where(found[:, 1] > 0, found[:, 1] + at + 1, at), self.b_len[ids], self.b_bytes
            first = np.zeros(len(ids), bool)
            first[(np.cumsum(n) - n)[n > 0]] = True
            base = np.repeat(byte0, n)
            end = refine(begin - base, end - base, length, first) + base
            place = np.searchsorted(ends, end)
            got = b"".join([decoded[i] for i in ids.tolist()])
            if got != whole or not np.isin(ends, end).all():
                size = np.bincount(np.minimum(place, len(segments) - 1), length, len(segments)).astype(np.int64)
                fits &= size == seg_size
                at = 0
                for k in range(len(segments)):
                    fits[k] &= got[at:at + seg_size[k]] == raw[k]
                    at += size[k]
                fits &= np.isin(ends, end)
            keep = (place < len(segments)) & (seg_unit[np.minimum(place, len(segments) - 1)] >= 0)
            place = place[keep]
            out |= {side: ids[keep], side + "_unit": seg_unit[place], side + "_end": end[keep] - begins[place]}
        if not (alone or fits.all()):  # one unit that doesn't come back must not touch its neighbours
            return self.tokens(units, alone=True)
        good = np.ones(len(units), bool)
        good[seg_unit[real]] = fits[real]
        return out | {"fits": good}

    def groups(self, units: list[str]) -> dict:
        """`tokens` of the units whose bytes came back, with the group of each token, and the groups' ends and units."""
        t = self.tokens(units)
        for side in "ab":
            keep = t["fits"][t[side + "_unit"]]
            for name in (side, side + "_unit", side + "_end"):
                t[name] = t[name][keep]
        base = np.cumsum(t["size"]) - t["size"]
        a_end, b_end = base[t["a_unit"]] + t["a_end"], base[t["b_unit"]] + t["b_end"]
        cuts = a_end[b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end] if len(b_end) else b_end
        t |= {"cut": cuts, "cut_unit": np.searchsorted(base, cuts, "left") - 1,
              "a_group": np.searchsorted(cuts, a_end), "b_group": np.searchsorted(cuts, b_end)}
        return t | {"n_a": np.bincount(t["a_group"], minlength=len(cuts)), "n_b": np.bincount(t["b_group"], minlength=len(cuts))}

    def _links(self, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit, pair code (a * |B| + b) and number of the links of all groups; a pair may come several times."""
        wide = t["n_a"] * t["n_b"] > WIDE_GROUP
        b0, width = np.cumsum(t["n_b"]) - t["n_b"], len(self.b_bytes)
        plain = ~wide[t["a_group"]]
        group = t["a_group"][plain]
        sizes = t["n_b"][group]
        codes = [np.repeat(t["a"][plain], sizes) * width + t["b"][_ranges(b0[group], sizes)]]
        units, times = [np.repeat(t["cut_unit"][group], sizes)], [np.ones(len(codes[0]), np.int64)]
        a0 = np.cumsum(t["n_a"]) - t["n_a"]
        for g in np.flatnonzero(wide).tolist():
            (a, m), (b, n) = (np.unique(t[s][o[g]:o[g] + t[k][g]], return_counts=True) for s, o, k in (("a", a0, "n_a"), ("b", b0, "n_b")))
            codes.append((a[:, None] * width + b).ravel())
            times.append(np.outer(m, n).ravel())
            units.append(np.full(len(codes[-1]), t["cut_unit"][g]))
        return np.concatenate(units), np.concatenate(codes), np.concatenate(times)

    def _names(self, t: dict, count: int) -> list[str]:
        """Each unit's groups as text, a semicolon behind each."""
        n_a, n_b = t["n_a"], t["n_b"]
        a_ends, b_ends = np.cumsum(n_a), np.cumsum(n_b)
        out = np.empty(len(t["a"]) + len(t["b"]), object)
        i = np.arange(len(t["a"]))
        where_a, last = i + (b_ends - n_b)[t["a_group"]], i + 1 == a_ends[t["a_group"]]
        out[where_a] = np.where(last, self.names[1][t["a"]], self.names[0][t["a"]])
        j = np.arange(len(t["b"]))
        last = j + 1 == b_ends[t["b_group"]]
        out[j + a_ends[t["b_group"]]] = np.where(last, self.names[2][t["b"]], self.names[0][t["b"]])
        ends = np.cumsum(np.bincount(t["a_unit"], minlength=count) + np.bincount(t["b_unit"], minlength=count)).tolist()
        flat = out.tolist()
        return ["".join(flat[s:e]) for s, e in zip([0, *ends], ends)]

    def learn(self, units: list[str]) -> None:
        """Align units that aren't known yet, a bounded number of bytes at a time."""
        at = 0
        while at < len(units):
            stop, held = at, 0
            while stop < len(units) and (stop == at or held + len(units[stop]) < 1 << 18):
                held += len(units[stop])
                stop += 1
            self._learn(units[at:stop])
            at = stop

    def _learn(self, units: list[str]) -> None:
        t = self.groups(units)
        n = len(units)
        sums = lambda place, w=None: np.bincount(place, w, n).astype(np.int64)
        self.size = np.vstack([self.size, np.stack([sums(t["a_unit"]), sums(t["b_unit"]), sums(t["cut_unit"]),
                                                    sums(t["cut_unit"], t["n_a"] * t["n_b"]), t["fits"].astype(np.int64)], axis=1)])
        self.labels += self._names(t, n)
        of, code, times = self._links(t)
        order = np.lexsort((code, of))
        of, code, times = of[order], code[order], times[order]
        new = np.r_[True, (of[1:] != of[:-1]) | (code[1:] != code[:-1])] if len(of) else np.empty(0, bool)
        starts = np.flatnonzero(new)
        self.pairs = np.concatenate([self.pairs, code[starts]])
        self.times = np.concatenate([self.times, np.add.reduceat(times, starts) if len(starts) else times])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.bincount(of[starts], minlength=n))])

    def lookup(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units of all texts in a row, and how many each text has."""
        found = [self.units(t) if t else [] for t in items]
        counts = np.array([len(u) for u in found], np.int64)
        flat = list(chain.from_iterable(found))
        place = list(map(self.index.get, flat))
        if None in place:
            fresh = list(dict.fromkeys(u for u, p in zip(flat, place) if p is None))
            if len(self.index) + len(fresh) > UNITS and self.index:
                self.forget()
                fresh = list(dict.fromkeys(flat))
            self.learn(fresh)
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
            place = list(map(self.index.__getitem__, flat))
        return np.array(place, np.int64), counts

    def measure(self, items: list[str]) -> dict:
        """Per text: tokens, groups, links, the digest of its groups, and its distinct pairs with their numbers of links."""
        place, counts = self.lookup(items)
        doc = np.repeat(np.arange(len(items)), counts)
        good = np.bincount(doc, 1 - self.size[place, 4], len(items)) == 0 if len(doc) else np.ones(len(items), bool)
        keep = good[doc]
        place, doc = place[keep], doc[keep]
        size = [np.bincount(doc, self.size[place, k], len(items)).astype(np.int64) for k in range(4)]
        ends = np.cumsum(np.bincount(doc, minlength=len(items))).tolist()
        flat = place.tolist()
        digests = [hashlib.sha256("".join([self.labels[u] for u in flat[s:e]])[:-1].encode()).hexdigest() if e > s else ""
                   for s, e in zip([0, *ends], ends)]
        # distinct units of each text first, then their pairs
        key, n = np.unique(doc * max(1, len(self.labels)) + place, return_counts=True)
        doc, place = np.divmod(key, max(1, len(self.labels)))
        sizes = self.at[place + 1] - self.at[place]
        rows = _ranges(self.at[place], sizes)
        codes = len(self.a_bytes) * len(self.b_bytes)
        key, times = np.repeat(doc, sizes) * codes + self.pairs[rows], np.repeat(n, sizes) * self.times[rows]
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        doc, pairs = np.divmod(key[starts], codes)
        return {"size": size, "digest": digests, "pairs": pairs, "times": np.add.reduceat(times, starts) if len(starts) else times[:0],
                "ends": np.cumsum(np.bincount(doc, minlength=len(items)))}


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.int64()))


def share(spark: SparkSession, a_path: str, b_path: str) -> Broadcast:
    """Both vocabulary files, read on the driver."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and the groups of every row: byte range in the space and the text, and the ids of both tokenizers.

    Texts that are null, empty, or don't come back from their tokens have no groups. Map-only.
    """
    spark = docs.sparkSession
    small_batches(spark, BATCH_BYTES)
    shared = share(spark, a_path, b_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        for batch in batches:
            for i, text in zip(batch.column(0), texts(batch, "text")):
                out = []
                if text:
                    t = aligner.groups(aligner.units(text))
                    if t["fits"].all():
                        a, b = (np.split(t[s], np.cumsum(t["n_" + s])[:-1]) for s in "ab")
                        out = [{"start": s, "end": e, "a": x.tolist(), "b": y.tolist()}
                               for s, e, x, y in zip([0, *t["cut"].tolist()], t["cut"].tolist(), a, b)]
                part = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], batch.schema.field(0).type), pa.array([out], pa.list_(part))], ["id", "groups"])
    made = widen(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).withColumn("text", text_of()).mapInArrow(
        releasing(run), f"id {kind}, groups array<struct<start: bigint, end: bigint, a: array<int>, b: array<int>>>")
    return made.select(F.col("id").alias(id_col), "groups")


def _measured(aligner: Aligner, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """Row ranges of the batch that hold about PART_BYTES of text, with what the aligner says of them."""
    for part in slices(batch, "text", PART_BYTES):
        yield part, aligner.measure(texts(part, "text"))


def aligned(docs: DataFrame, shared: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """One stored row per row of `docs`: its numbers, digest, and distinct id pairs with their links; `row` is unique."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = Aligner(*shared.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, m in _measured(aligner, batch):
                numbers = np.arange(row, row + part.num_rows)
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers), part.column(0), *(pa.array(s) for s in m["size"]), pa.array(m["digest"]),
                     _lists(m["pairs"], m["ends"]), _lists(m["times"], m["ends"])],
                    ["row", "id", "n_a", "n_b", "n_groups", "n_links", "digest", "pairs", "times"])
    rows = widen(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).withColumn("text", text_of())
    return store(rows.mapInArrow(releasing(run), f"row bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, digest string, "
                                      "pairs array<bigint>, times array<bigint>"), "aligned")


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """pair, n (how many rows hold it), best (no pair of its first id has a higher n), stored.

    Counts are combined before the shuffle; a first id has at most as many pairs as there are second ids.
    """
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = store(counts, "pair-counts")
    a = F.floor(F.col("pair") / b_size)
    tops = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    joined = counts.withColumn("a", a).join(tops, "a")
    return joined.select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """`id_col`, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A group links all its tokens of one tokenizer with all its tokens of the other. A pair's count is the number
    of rows that hold it linked. The `head_pairs` most frequent pairs, in steps of a power of two, are
    looked up in a broadcast; rows' other pairs are joined by shuffle, where none is frequent. Null
    and empty texts, and texts that don't come back from their tokens, have zeros and an empty digest. Repeated
    rows count each; other columns are never read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark, BATCH_BYTES)
    shared = share(spark, a_path, b_path)
    rows = aligned(docs, shared, id_col, text_col)
    counts = store(pair_counts(rows, len(Aligner(*shared.value).b_bytes)), "pairs")
    steps = counts.agg(*(F.count(F.when(F.col("n") >= 1 << k, 1)).alias(str(k)) for k in range(48))).first()
    least = next((1 << k for k in range(48) if steps[k] <= head_pairs), 1 << 48)
    head = counts.where(F.col("n") >= least).toPandas().sort_values("pair")
    known = spark.sparkContext.broadcast((head["pair"].to_numpy(np.int64), head["n"].to_numpy(np.int64), head["best"].to_numpy(bool)))
    others = least > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        for batch in batches:
            pairs, times = (batch.column(k).flatten().to_numpy() for k in (2, 3))
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy()
            of = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            count, top = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            np.add.at(count, of[hit], n[at[hit]] * times[hit])
            np.add.at(top, of[hit], best[at[hit]] * times[hit])
            ends = np.cumsum(np.bincount(of[~hit], minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(top), pa.array(count),
                                              _lists(pairs[~hit], ends), _lists(times[~hit], ends)],
                                             ["row", "numbers", "n_best", "count_sum", "pairs", "times"])
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "digest"]
    numbers = rows.select(*names).schema.simpleString()
    found = rows.select("row", F.struct(*names).alias("numbers"), "pairs", "times").mapInArrow(
        releasing(run), f"row bigint, numbers {numbers}, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")
    if others:
        found = store(found, "linked")
        rest = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.*").withColumnRenamed("pairs", "pair")
        sums = rest.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
        found = found.join(sums, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return found.select(F.col("numbers.id").alias(id_col), *(f"numbers.{c}" for c in names[1:5]), "n_best", "count_sum",
                        F.col("numbers.digest").alias("groups_sha256"))
