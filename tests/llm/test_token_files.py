import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkvec.llm import token_files
from sparkvec.llm.queries import QUERIES, vocabulary

VOCABULARY = vocabulary("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1), st.just(0)), max_size=400),
       st.sampled_from([3, 64, 4096]))
def test_round_trip(ids, block):
    ids = np.array(ids, np.uint64)
    words, offsets = token_files.pack(ids, block)
    assert (token_files.unpack(words, offsets.astype(np.int64), len(ids), block) == ids).all()


def test_blocks_stand_alone():
    ids = np.random.default_rng(0).integers(0, 50_000, 10_000).astype(np.uint64)
    words, offsets = token_files.pack(ids, 4096)
    part = token_files.unpack(words[offsets[1]:offsets[2]], np.array([0, offsets[2] - offsets[1]]), 4096, 4096)
    assert (part == ids[4096:8192]).all()


def test_word_counts_are_those_of_the_code():
    assert len(token_files.pack(np.zeros(120, np.uint64))[0]) == 1
    assert len(token_files.pack(np.ones(60, np.uint64))[0]) == 1
    assert len(token_files.pack(np.full(8, (1 << 15) - 1, np.uint64))[0]) == 2
    assert len(token_files.pack(np.full(1, 1 << 60, np.uint64))[0]) == 2


def brute(rows):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("page,shards", [(1 << 20, 1), (20, 5)])
def test_files_against_the_library(spark, monkeypatch, page, shards):
    monkeypatch.setattr(token_files, "PAGE_IDS", page)
    texts = ["Some Text", None, "", "  \n", "é É ß\xa0x", "<|endoftext|> a <|ENDOFTEXT|>", "word " * 3000, "don't WE'LL 12½", "가 ᄀ ᅡ Σας"]
    rows = [(7 * i % 40 - 5, t) for i, t in zip(range(40), itertools.cycle(texts))] + [(3, "Some Text"), (3, "more"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id bigint, text string, shard int, ids string")
    path = token_files.new_folder(spark)
    token_files.write_with_library(docs, path, VOCABULARY, 1, shards=shards)
    got = token_files.read(spark, path, token_files.crc32, "bigint", "crc").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)


def test_empty_table(spark):
    path = token_files.new_folder(spark)
    token_files.write_with_library(spark.createDataFrame([], "doc_id bigint, text string"), path, VOCABULARY, 1)
    assert token_files.read(spark, path).count() == 0


def test_query_reads_every_document(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op4_token_files"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute([tuple(r) for r in rows])


def test_new_pieces_go_to_the_library_in_few_texts():
    """Signs behind a letter are a piece of their own, and new pieces are joined."""
    class Counting:
        def __init__(self, inner):
            self.inner, self.pieces, self.texts = inner, 0, 0

        def __getattr__(self, name):
            def call(texts, **options):
                self.texts += len(texts)
                self.pieces += sum(len(t.split()) for t in texts)
                return getattr(self.inner, name)(texts, **options)
            return call
    with open(VOCABULARY, encoding="utf-8") as file:
        state = {"json": file.read()}
    token_files.library_encoder(state)
    state["tokenizer"] = counting = Counting(state["tokenizer"])
    words = ["wort" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(300)]
    text = " ".join(w + sign for w in words for sign in ("", ",", ".", "!?", "'s", "'"))
    ids, counts = token_files.library_encoder(state)([text, "é, ½, 7. <|endoftext|>. Á,", ""])
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "é, ½, 7. <|endoftext|>. Á,", "")]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert counting.texts <= 10 and counting.pieces < 620
