import random

import numpy as np
import pytest

from sparkvec.llm import vector_codes as C


def brute(rows, parts, entries, rounds):
    """Codes, errors and codebooks by plain Python integers."""
    import math
    whole = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(256 * x) for x in v] for _, v, _ in whole]
    order = sorted(range(len(whole)), key=lambda k: (whole[k][0] is None, whole[k][0] or 0, whole[k][1]))[:entries]
    w = len(ints[0]) // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut(ints[k], p) for k in order] for p in range(parts)]

    def assign():
        out = []
        for v in ints:
            out.append([min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return out
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for v, a in zip(ints, at) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    at = assign()
    errors = [sum(d for d, _ in a) for a in at]
    total = {}
    for (_, _, lab), e in zip(whole, errors):
        total[lab] = total.get(lab, 0) + e
    return sorted(((str(i), "".join(f"{k:02x}" for _, k in a), e, total[lab]) for (i, _, lab), a, e in zip(whole, at, errors))), np.array(books)


def example(seed, n=150, dim=8):
    r = random.Random(seed)
    f = lambda x: float(np.float32(x))
    rows = [(i * 7 % 151, [f(r.gauss(0, 0.3)) for _ in range(dim)], r.choice([0, 1, None])) for i in range(n)]
    rows += [(1000, None, 1), (1001, [float("nan")] * dim, 1), (1002, [None] * dim, 0), (1003, [f(1.0)] * (dim - 1) + [float("-inf")], 0)]
    rows += [(None, [f(0.25)] * dim, None)] + [(500, [f(-0.5)] * dim, 2)] * 60 + [(2, rows[3][1], 0)]
    return rows


@pytest.mark.parametrize("parts,entries,rounds", [(4, 8, 2), (2, 5, 4), (8, 64, 1), (1, 3, 0)])
def test_against_plain_integers(spark, parts, entries, rounds):
    rows = example(entries)
    # columns whose names the operator uses inside
    table = spark.createDataFrame([(*r, 9, "x", 1.5) for r in rows],
                                  "vec_id bigint, embedding array<float>, label int, pos int, code string, v double").repartition(5)
    want, books = brute(rows, parts, entries, rounds)
    got = C.compress(table, parts, entries, rounds).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got) == want
    assert {r["codebooks_sha256"] for r in got} == {C.fingerprint(books)}


def test_salts_and_label_join_change_nothing(spark, monkeypatch):
    rows = example(1)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    want = sorted(map(str, C.compress(table, 4, 8, 2).collect()))
    monkeypatch.setattr(C, "LABELS_BROADCAST", 0)
    assert sorted(map(str, C.compress(table.repartition(7), 4, 8, 2).collect())) == want
    a, b = (C.train(table, 4, 8, 3, salts=s) for s in (1, 13))
    assert (a == b).all()


def test_only_changed_parts_move(spark):
    table = spark.createDataFrame(example(3), "vec_id bigint, embedding array<float>, label int")
    kept = table.select("embedding").where(C.is_whole("embedding"))
    books = C.train(table, 4, 8, 0)
    members = C.deal(kept, books, "embedding", 2)
    books = C.update(members, books)
    plan = C.migrate(members, books)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pos") == 1 and "Union" in plan
    again = C.migrate(members, books)
    assert {(r["pos"], r["entry"], tuple(r["part"])) for r in again.collect()} == {
        (r["pos"], int(C.nearest(np.array([r["part"]]), books[r["pos"]])[0][0]), tuple(r["part"])) for r in members.collect()}
    assert again.agg({"n": "sum"}).first()[0] == 4 * kept.count()


def test_large_components_and_bad_lengths(spark):
    big = np.array([[1 << 29, -(1 << 29)], [3, 4]], np.int64)
    index, distance = C.nearest(big, np.array([[0, 0], [1 << 29, 1 - (1 << 29)]], np.int64))
    assert index.tolist() == [1, 0] and distance.tolist() == [1, 25]
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="one length"):
        C.encode(table, C.train(table.where("vec_id = 1"), 2, 4)).collect()


def test_empty_and_decoded(spark):
    table = spark.createDataFrame([(1, [0.5, -0.25, 1.0, 0.125], 3)], "vec_id bigint, embedding array<float>, label int")
    assert C.compress(table.limit(0)).collect() == []
    assert C.compress(table.limit(0)).columns == C.compress(table, 2).columns
    books = C.train(table, 2)
    assert C.decode(C.encode(table, books), books).first()["vector"] == [0.5, -0.25, 1.0, 0.125]
