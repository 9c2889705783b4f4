import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkvec.llm import bpe
from sparkvec.llm.queries import QUERIES, vocabulary

PATH = vocabulary("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MODEL = bpe.load(PATH)
ENCODER = bpe.Encoder(MODEL)
PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "\xa0", "é", "ß", "12", "½", "!!", "'s", "'", "'ll", "<|endoftext|>", "日本", "🙂",
          "́", "\x85", "x" * 300, " \n", "\x1c", "​", "\r\n", "_", "²"]


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - n:e].tolist() for e, n in zip(ends, counts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=12)), max_size=40).map("".join))
def test_same_as_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert split(*ENCODER.encode([text])) == [want]
    assert bpe.decode(MODEL, np.array(want, np.int64)) == LIBRARY.decode(want, skip_special_tokens=False)


def test_pairs_are_judged_as_by_merging_them():
    r = random.Random(0)
    own = MODEL["own"].tolist()
    a, b = (np.array([r.choice(own) for _ in range(4000)]) for _ in range(2))
    good = bpe.compatible(MODEL, a, b)
    assert good.tolist() == [bpe._merge(MODEL, MODEL["tokens"][x] + MODEL["tokens"][y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]


def test_long_words_merge_alike(monkeypatch):
    word = "".join(random.Random(1).choice("abcdeth") for _ in range(199)).encode()
    ids = [MODEL["single"][b] for b in word]
    assert bpe._merge(MODEL, word) == bpe._merge_long(MODEL["merges"], MODEL["size"], ids)


def test_cache_is_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    encoder = bpe.Encoder(MODEL)
    for n in range(5):
        text = " ".join(f"word{n}{i}" for i in range(40))
        assert split(*encoder.encode([text, ""])) == [LIBRARY.encode(text).ids, []]


def test_tables(spark):
    rows = [(1, "Hello there"), (1, "Hello there"), (2, None), (3, ""), (None, "x"), (4, "long " * 50_000), (5, "y" * 5000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, ids int")
    encoded = bpe.encode_table(docs, PATH)
    got = sorted((str(r[0]), r[1]) for r in encoded.collect())
    assert got == sorted((str(i), LIBRARY.encode(t or "").ids) for i, t in rows)
    assert sorted(str((r[0], r[1])) for r in bpe.decode_table(encoded, PATH).collect()) == sorted(str((i, t or "")) for i, t in rows)
    assert bpe.encode_table(docs.limit(0), PATH).count() == 0


def test_query(spark, sf_dir):
    for r, d in zip(QUERIES["op1_bpe"](spark, sf_dir).orderBy("doc_id").collect(),
                    spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()):
        ids = LIBRARY.encode(d["text"] or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert tuple(r) == (d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                            hashlib.sha256(text.encode()).hexdigest())
