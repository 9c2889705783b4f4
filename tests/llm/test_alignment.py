import hashlib
import os
import subprocess
import sys
from collections import defaultdict

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkvec.llm import alignment as L
from sparkvec.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
TOKENIZER = Tokenizer.from_file(A)
TOKENIZER.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)


def brute_groups(text):
    """Groups as (a ids, b ids) of one text by the libraries' ids and decoded bytes alone, over the whole text."""
    if not text:
        return []
    letters = {c: b for c, b in L.byte_alphabet().items()}
    a = [(i, bytes(letters[c] for c in TOKENIZER.id_to_token(i))) for i in TOKENIZER.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in PIECES.encode(text):
        piece = PIECES.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if PIECES.is_byte(i) else piece.replace("▁", " ").encode()))
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
        return []
    out, i, j = [], 0, 0
    while i < len(a):
        left, right, x, y = [a[i][0]], [b[j][0]], len(a[i][1]), len(b[j][1])
        i, j = i + 1, j + 1
        while x != y:
            if x < y:
                left.append(a[i][0])
                x, i = x + len(a[i][1]), i + 1
            else:
                right.append(b[j][0])
                y, j = y + len(b[j][1]), j + 1
        out.append((left, right))
    return out


def brute(rows):
    groups = [(i, brute_groups(t)) for i, t in rows]
    count = defaultdict(int)
    for _, gs in groups:
        for pair in {(x, y) for a, b in gs for x in a for y in b}:
            count[pair] += 1
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for i, gs in groups:
        links = [(x, y) for a, b in gs for x in a for y in b]
        digest = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((i, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(digest.encode()).hexdigest() if gs else ""))
    return sorted(map(str, out))


ODD = ["", " ", "  two  spaces ", "a\n \nb  c", "\ttab  x", "<s> </s> <|endoftext|> <0x41> <unk>", "hé \U0001F9FF中\U0001F9FF\U0001F468‍\U0001F469 x",
       "a▁b", "▁", "!\x1c x\x1c", "x\x00y", "é́ ﬁ Å", "don't we'll 'S I'M", "1234567 8.9", "a" * 700 + " " + "中" * 90, "  　 　x",
       "foo.bar\nBaz\n\nQux -x\nñu 2x x2 a's 's\n't", "\nfoo", "x\n", "foo\n bar", "é.é\u0301. a\u0301 b", "กำ नि", "x \n y\r\n z\r", "\U0001F9FF" * 30]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id bigint, text string, row int, pairs string")


@pytest.mark.parametrize("head", [10 ** 6, 40, 0])
def test_against_the_whole_texts(spark, head):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "the cat the cat"), (7, "the cat"), (7, "the cat"), (90, None)]
    rows += [(200 + k, " ".join(ODD[k:k + 4])) for k in range(len(ODD))]
    got = L.align(table(spark, rows).repartition(3), A, B, head_pairs=head)
    assert sorted(map(str, map(tuple, got.collect()))) == brute(rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = L.align(docs, A, B)
    assert sorted(map(str, map(tuple, got.collect()))) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty(spark):
    assert L.align(table(spark, []), A, B).collect() == []
    assert [tuple(r) for r in L.align(table(spark, [(3, None)]), A, B).collect()] == [(3, 0, 0, 0, 0, 0, 0, "")]


ALIGNER = L.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())


@settings(max_examples=1500, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t \x1c'.aé中\U0001F9FF▁<0x>s"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_units_equal_the_whole_text(text):
    want = brute_groups(text)
    m = ALIGNER.measure([text])
    assert [int(s[0]) for s in m["size"]] == [sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want), sum(len(a) * len(b) for a, b in want)]


def test_wide_groups_and_forgetting(monkeypatch):
    items = ["a" * 700, "the \U0001F9FF\U0001F9FF cat", "zzzzzzzzzzzzzzz the"]
    want = L.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read()).measure(items)
    monkeypatch.setattr(L, "WIDE_GROUP", 2)
    monkeypatch.setattr(L, "UNITS", 2)
    other = L.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    other.measure(["some other words here"])
    got = other.measure(items)
    for name in ("pairs", "times", "ends"):
        assert got[name].tolist() == want[name].tolist()
    assert got["digest"] == want["digest"]


def test_groups_are_byte_ranges(spark):
    rows = [(1, "hé \U0001F9FF中 x"), (2, None), (3, "a▁b")]
    got = {r["doc_id"]: r["groups"] for r in L.token_groups(table(spark, rows), A, B).collect()}
    assert got[2] == got[3] == []
    raw = (" " + rows[0][1]).encode()
    assert [(g["a"], g["b"]) for g in got[1]] == brute_groups(rows[0][1])
    assert got[1][0]["start"] == 0 and got[1][-1]["end"] == len(raw) and all(x["end"] == y["start"] for x, y in zip(got[1], got[1][1:]))


def test_refine_splits_a_shared_character():
    import numpy as np
    # two tokens share a three-byte character, a third one ends it and takes two bytes of the next
    begin, end, length = np.array([0, 1, 1, 4]), np.array([1, 4, 7, 7]), np.array([1, 2, 3, 1])
    assert L.refine(begin, end, length, np.array([True, False, False, False])).tolist() == [1, 3, 6, 7]


def test_a_worker_looks_up_about_a_megabyte_of_text_at_once():
    import pyarrow as pa
    from types import SimpleNamespace
    held = []
    batch = pa.RecordBatch.from_arrays([pa.array(range(41)), pa.array(["x" * 100_000] * 40 + [None])], ["id", "text"])
    parts = [p for p, _ in L._measured(SimpleNamespace(measure=lambda t: held.append(sum(map(len, t)))), batch)]
    assert sum(held) == 4_000_000 and max(held) <= 1 << 20
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(41))


def test_a_worker_starts_no_threads_of_the_library():
    code = """
from sparkvec.llm import alignment as L
from sparkvec.llm.queries import vocabulary
def threads():
    with open("/proc/self/status") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("Threads:"))
aligner = L.Aligner(open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read(), open(vocabulary("piece_bpe_32k.model"), "rb").read())
before = threads()
aligner.measure([" ".join(f"word{i} und {i}" for i in range(20_000))])
print(threads() - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120,
                         env=env | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert out.stdout.strip() == "0"
