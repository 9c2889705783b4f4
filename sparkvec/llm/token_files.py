"""Token files: ids of many documents packed by Simple-8b into 64-bit words, with offsets for block access.

A file holds pages in document order; a page holds whole documents. Its ids are cut into blocks of
BLOCK ids that are packed on their own, so `offsets` gives the first word of each block and every block
can be decoded alone, and all blocks of a page are packed and unpacked together in NumPy.

Word layout: the top four bits select how many ids of which width fill the other sixty.
    0            escape: the next word is one id as it is, all 64 bits
    1            120 ids that are all zero
    2 .. 15      60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1 ids, the first in the lowest bits
The last word of a block may hold fewer ids than its selector allows; counts come from the page.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.session import ensure_checkpoint_dir

from .common import SLICE_BYTES, shard_bounds, shard_count, shard_of, slices, small_batches, text_of, texts

BLOCK = 4096
PAGE_IDS = 1 << 20
# Fixed values of the code: ids in a word and bits of each, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
# Ids from 2**60 on take an escape; widths are told apart up to that.
WIDEST = 60

PAGE_SCHEMA = ("shard int, page int, n_ids bigint, doc_ids array<bigint>, doc_lens array<int>, "
               "offsets array<int>, words binary")


SMALL_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id takes: 0 for zero."""
    if int(ids.max()) < len(SMALL_BITS):
        return SMALL_BITS[ids]
    parts = [SMALL_BITS[(ids >> np.uint64(16 * k)) & np.uint64(0xFFFF)] for k in range(4)]
    out = parts[0]
    for k in (1, 2, 3):
        out = np.where(parts[k] > 0, parts[k] + np.uint8(16 * k), out)
    return out


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids, and the first word of each block with the total behind them.

    Each block is followed by zeros in a row of its own, so a word never reaches into the next block.
    At every position the code that takes most ids is found by running maxima of their widths.
    """
    ids = np.asarray(ids).astype(np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int32)
    rows = -(-n // block)
    reach = int(COUNTS.max())
    padded = np.zeros((rows, block + reach), np.uint64)
    full = np.zeros(rows * block, np.uint64)
    full[:n] = ids
    padded[:, :block] = full.reshape(rows, block)
    flat = padded.ravel()
    widest = _bits(flat)  # of the ids in a growing window that starts at each position
    selector = np.where(widest <= WIDEST, np.uint8(15), np.uint8(0))
    size, total = 1, len(flat)
    for code in range(14, 0, -1):
        grow = int(COUNTS[code]) - size  # never over `size`, so two windows cover the next one
        widest[:total - grow] = np.maximum(widest[:total - grow], widest[grow:])
        size += grow
        np.putmask(selector, widest <= WIDTHS[code], np.uint8(code))
    after = np.arange(total) + COUNTS[selector]
    firsts = np.arange(rows) * (block + reach)
    ends = firsts + np.minimum(block, n - np.arange(rows) * block)
    heads = _walk(after, firsts, ends)
    codes = selector[heads].astype(np.int64)
    words_of = np.where(codes == 0, 2, 1)
    first = np.cumsum(words_of) - words_of
    words = np.zeros(int(words_of.sum()), np.uint64)
    words[first] = codes.astype(np.uint64) << np.uint64(60)
    for code in np.unique(codes).tolist():
        mine = np.flatnonzero(codes == code)
        if code == 0:
            words[first[mine] + 1] = flat[heads[mine]]
        elif WIDTHS[code]:
            shifts = (np.arange(COUNTS[code]) * WIDTHS[code]).astype(np.uint64)
            values = flat[heads[mine, None] + np.arange(COUNTS[code])] << shifts
            words[first[mine]] |= np.bitwise_or.reduce(values, axis=1)
    return words, np.append(first[np.searchsorted(heads, firsts)], len(words)).astype(np.int32)


def _walk(after: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First id of each word: all blocks step from word to word together."""
    heads, at = [], starts
    while len(at):
        heads.append(at)
        at = after[at]
        live = at < ends
        if not live.all():
            at, ends = at[live], ends[live]
    return np.sort(np.concatenate(heads))


def unpack(words: np.ndarray, offsets: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """Ids of consecutive blocks that `pack` made; `offsets` are relative to `words`."""
    words = np.asarray(words, np.uint64)
    out = np.zeros(n_ids, np.uint64)
    if not n_ids:
        return out
    codes = (words >> np.uint64(60)).astype(np.int64)
    literal = _literals(codes, offsets)
    rows = np.flatnonzero(~literal)
    codes = codes[rows]
    counts = COUNTS[codes]
    of_block = np.searchsorted(offsets, rows, "right") - 1
    running = np.cumsum(counts) - counts
    first_row = np.searchsorted(rows, offsets[:-1])
    start = of_block * block + running - running[first_row][of_block]
    limit = np.minimum((of_block + 1) * block, n_ids)
    for code in np.unique(codes).tolist():
        mine = np.flatnonzero(codes == code)
        if code == 0:
            out[start[mine]] = words[rows[mine] + 1]
        elif code > 1:
            shifts = (np.arange(COUNTS[code]) * WIDTHS[code]).astype(np.uint64)
            values = (words[rows[mine], None] >> shifts) & np.uint64((1 << int(WIDTHS[code])) - 1)
            at = start[mine, None] + np.arange(COUNTS[code])
            valid = at < limit[mine, None]
            out[at[valid]] = values[valid]
    return out


def _literals(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words that are the raw id behind an escape. A run of words that look like escapes alternates."""
    zero = codes == 0
    if not zero.any():
        return zero
    literal = np.zeros(len(codes), bool)
    last = -1
    for i in np.flatnonzero(zero).tolist():
        if i != last:
            literal[i + 1] = True
            last = i + 1
    return literal


def write(docs: DataFrame, path: str, make: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]],
          end_id: int | None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encode every text and write its ids in ascending order of `id_col` as token files under `path`.

    `make()` gives a worker's encoder: texts -> (ids of all in a row, count of each). `end_id` is
    appended to each document. Null texts are empty. Rows are cut into shards by id, so only texts are
    shuffled, once; rows without an id come first, and rows that repeat an id follow each other in an
    order fixed by their text. Memory: a slice of texts and a page.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or shard_count(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).withColumn("text", text_of())
    bounds = shard_bounds(docs.select(docs[id_col].cast("long").alias("id")), "id", shards)
    rows = rows.withColumn("shard", shard_of("id", bounds)).repartitionById(len(bounds) + 1, "shard")
    rows = rows.sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, size, page, shard = make(), [], 0, 0, None
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, counts = encode(texts(part, "text"))
                bounds_ = np.concatenate([[0], np.cumsum(counts)])
                for k, (doc, own) in enumerate(zip(part.column("id").to_pylist(), part.column("shard").to_pylist())):
                    if held and (own != shard or size >= PAGE_IDS):
                        yield _page(shard, page, held)
                        page, held, size = page + 1 if own == shard else 0, [], 0
                    shard = own
                    mine = ids[bounds_[k]:bounds_[k + 1]].astype(np.uint64)
                    if end_id is not None:
                        mine = np.append(mine, np.uint64(end_id))
                    held.append((doc, mine))
                    size += len(mine)
        if held:
            yield _page(shard, page, held)
    rows.mapInArrow(run, PAGE_SCHEMA).write.option("compression", "zstd").parquet(path)


def _page(shard: int, page: int, held: list) -> pa.RecordBatch:
    ids = np.concatenate([x for _, x in held])
    words, offsets = pack(ids)
    values = [[shard], [page], [len(ids)], [[d for d, _ in held]], [[len(x) for _, x in held]], [offsets.tolist()],
              [words.astype("<u8").tobytes()]]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)],
                                      ["shard", "page", "n_ids", "doc_ids", "doc_lens", "offsets", "words"])


def page_starts(pages: DataFrame) -> DataFrame:
    """Adds `start`, the number of ids before each page.

    Shards are totalled first; the running sum over shards reads one row per shard, and the one within a
    shard one row per page of that shard.
    """
    from pyspark.sql import Window
    sums = pages.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    whole = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("shard").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("shard", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("before"))
    numbered = pages.select("shard", "page", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inside"))
    return numbered.join(before, "shard").select("shard", "page", (F.col("before") + F.col("inside")).alias("start"))


def read(spark: SparkSession, path: str, summary: Callable[[np.ndarray], object] | None = None,
         kind: str = "array<bigint>", name: str = "ids") -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before it), n_tokens, and the ids.

    With `summary`, the column `name` of type `kind` holds `summary(ids)` in place of the ids.
    A folder without pages gives an empty table.
    """
    pages = spark.read.schema(PAGE_SCHEMA).parquet(path)
    placed = pages.join(page_starts(pages), ["shard", "page"])
    make = summary or (lambda ids: ids.astype(np.int64).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, n, docs, lens, offsets, words = (batch.column(c)[row] for c in range(6))
                ids = unpack(np.frombuffer(words.as_py(), "<u8"), np.array(offsets.as_py(), np.int64), n.as_py())
                lens = np.array(lens.as_py(), np.int64)
                ends = np.cumsum(lens)
                made = [make(ids[e - k:e]) for e, k in zip(ends.tolist(), lens.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(start.as_py() + ends - lens), pa.array(lens), pa.array(made)],
                    ["doc_id", "start", "n_tokens", name])
    return placed.select("start", "n_ids", "doc_ids", "doc_lens", "offsets", "words").mapInArrow(
        run, f"doc_id bigint, start bigint, n_tokens bigint, {name} {kind}")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def library_encoder(state: dict) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encoder by the tokenizers library for a vocabulary that drops white space.

    `state` holds the vocabulary file's content and lives with the worker. Pieces between ASCII white
    space are encoded by the library once and remembered, ASCII letters lowered first as the vocabulary
    lowers all; nothing in the library's rules reaches across white space, so new pieces are encoded in joined
    texts and told apart by their offsets. Where the vocabulary parts signs from letters, signs behind an ASCII
    letter or digit are a piece of their own. Pieces that may hold a special token keep their case.
    """
    if "tokenizer" not in state:
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(state["json"])
        tokenizer.no_truncation()
        tokenizer.no_padding()
        state["tokenizer"] = tokenizer
        state["parts"] = (json.loads(state["json"]).get("pre_tokenizer") or {}).get("pretokenizers", [None])[0] == SIGNS_APART
        _forget(state)
    tokenizer = state["tokenizer"]

    def learn(numbers: _Numbers) -> None:
        made, counts = [], []
        for at in range(0, len(numbers.new), 20_000):
            chunk = [p.decode() for p in numbers.new[at:at + 20_000]]
            joined = [" ".join(chunk[k:k + JOINED]) for k in range(0, len(chunk), JOINED)]
            encoded = tokenizer.encode_batch(joined, add_special_tokens=False)
            n = np.fromiter(map(len, encoded), np.int64, len(encoded))
            made.append(np.fromiter(chain.from_iterable(e.ids for e in encoded), np.int32, int(n.sum())))
            first = np.fromiter((o[0] for e in encoded for o in e.offsets), np.int64, int(n.sum()))
            sizes = np.fromiter(map(len, joined), np.int64, len(joined)) + 1
            first += np.repeat(np.cumsum(sizes) - sizes, n)
            ends = np.cumsum(np.fromiter(map(len, chunk), np.int64, len(chunk)) + 1)
            counts.append(np.bincount(np.searchsorted(ends, first, "right"), minlength=len(chunk)))
        known = len(state["lens"])
        lens = np.concatenate([state["lens"], np.zeros(len(numbers) - known, np.int64)])
        starts = np.concatenate([state["starts"], np.zeros(len(numbers) - known, np.int64)])
        ids = np.concatenate([state["ids"], *made])
        own = np.array(numbers.places, np.int64)
        lens[own] = np.concatenate([np.empty(0, np.int64), *counts])
        starts[own] = len(state["ids"]) + np.cumsum(lens[own]) - lens[own]
        if numbers.pairs:
            pairs = np.array(numbers.pairs, np.int64)
            both = lens[pairs[:, 1:]]
            lens[pairs[:, 0]] = both.sum(axis=1)
            starts[pairs[:, 0]] = len(ids) + np.cumsum(lens[pairs[:, 0]]) - lens[pairs[:, 0]]
            ids = np.concatenate([ids, ids[_ranges(starts[pairs[:, 1:].ravel()], both.ravel())]])
        state["lens"], state["starts"], state["ids"] = lens, starts, ids
        numbers.new, numbers.places, numbers.pairs = [], [], []

    def encode(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(state["numbers"]) > CACHE_PIECES:
            _forget(state)
        numbers = state["numbers"]
        found: list[bytes] = []
        ends = [0]
        for text in items:
            raw = text.encode()
            if b"<|" in raw:
                found += [p if b"<|" in p else p.lower() for p in raw.split()]
            else:
                found += raw.lower().split()
            ends.append(len(found))
        number = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
        if numbers.new or numbers.pairs:
            learn(numbers)
        size = state["lens"][number]
        ahead = np.concatenate([[0], np.cumsum(size)])
        return state["ids"][_ranges(state["starts"][number], size)], np.diff(ahead[np.array(ends)])
    return encode


# Pieces that a worker remembers; at this number it starts anew. New pieces that are encoded as one text.
CACHE_PIECES, JOINED = 600_000, 100
# Rule of a vocabulary by which a run of signs behind a letter or digit is always a word of its own.
SIGNS_APART = {"type": "Split", "behavior": "Removed", "invert": True,
               "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}}
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... of all ranges in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Numbers(dict):
    """Number of each piece. `new` are pieces for the library, `places` their numbers, `pairs` (number, stem's, signs')."""

    def __init__(self, parts: bool):
        super().__init__()
        self.parts = parts
        self.new: list[bytes] = []
        self.places: list[int] = []
        self.pairs: list[tuple[int, int, int]] = []

    def __missing__(self, piece: bytes) -> int:
        if self.parts:
            stem = piece.rstrip(SIGNS)
            if stem and len(stem) < len(piece) and stem[-1:].isalnum() and b"<|" not in piece:
                both = self[stem], self[piece[len(stem):]]
                self[piece] = number = len(self)
                self.pairs.append((number, *both))
                return number
        self[piece] = number = len(self)
        self.new.append(piece)
        self.places.append(number)
        return number


def _forget(state: dict) -> None:
    state["numbers"] = _Numbers(state["parts"])
    state["starts"], state["lens"], state["ids"] = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)


def write_with_library(docs: DataFrame, path: str, vocabulary: str, end_id: int | None, **options) -> None:
    """`write` with the tokenizers library and the vocabulary file at `vocabulary` on the driver."""
    with open(vocabulary, encoding="utf-8") as file:
        state = docs.sparkSession.sparkContext.broadcast({"json": file.read()})
    write(docs, path, lambda: library_encoder(state.value), end_id, **options)


def new_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/sparkvec-llm-tokens-{uuid.uuid4().hex[:12]}"
