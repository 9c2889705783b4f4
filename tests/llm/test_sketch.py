import hashlib
import random

import numpy as np
import pytest

from sparkvec.llm import sketch as S


def brute(rows, shift):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        a, b, c = (S.sketch(x, 5, shift) for x in (text, edited, after))
        out.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), S.encode(a), S.encode(b), S.likeness(a, b), S.likeness(a, c)))
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 2, 7])
def test_next_document_across_shards(spark, shards):
    r = random.Random(shards)
    words = ["eins", "zwei", "drei", "vier", "fünf", "🙂", "x\ny"]
    rows = [(3 * i - 20, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 40, 300])))) for i in range(30)]
    rows += [(1000, None), (1001, ""), (4, "twice a"), (4, "twice b"), (None, "no id"), (None, "no id two")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id bigint, text string, shard int, ahead int")
    got = S.compare_with_edits(docs, shards=shards).collect()
    assert sorted((str(x[0]), *x[1:7]) for x in got) == brute(rows, S.SHIFT)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id bigint, text string")
    assert [(x["doc_id"], x["near_next"]) for x in S.compare_with_edits(one).collect()] == [(5, 1.0)]
    assert S.compare_with_edits(one.limit(0)).count() == 0
    assert S.sketch_table(one.limit(0)).count() == 0


def test_estimates_follow_the_true_similarity():
    r = random.Random(0)
    base = [f"w{r.randrange(10**6)}" for _ in range(6000)]
    a, b = S.sketch(" ".join(base)), S.sketch(" ".join(base[:1500]))
    assert abs(S.containment(b, a) - 1) < 0.01 and abs(S.containment(a, b) - 0.25) < 0.04
    other = S.sketch(" ".join(base[3000:] + [f"v{i}" for i in range(3000)]))
    assert abs(S.likeness(a, other) - 1 / 3) < 0.05


def test_merge_is_the_sketch_of_the_union():
    r = random.Random(1)
    x, y = ([f"w{r.randrange(50)}" for _ in range(400)] for _ in range(2))
    hashes = np.concatenate([S.shingle_hashes(" ".join(z), 5) for z in (x, y)])
    kept = np.unique(hashes[hashes < np.uint64(1 << (64 - S.SHIFT))] >> np.uint64(64 - S.SHIFT - S.KEPT_BITS))
    assert (S.merge(S.sketch(" ".join(x)), S.sketch(" ".join(y))) == kept).all()


def test_printed_form():
    for text in ("", "one", "two words", "a b c d e f g " * 50):
        values = S.sketch(text)
        assert (S.decode(S.encode(values)) == values).all()
    assert S.encode(S.sketch(" A  b\n")) == S.encode(S.sketch("a b")) != ""
