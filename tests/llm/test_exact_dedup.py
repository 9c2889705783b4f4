import hashlib

import pytest

from sparkvec.llm import exact_dedup

ROWS = [(1, "same"), (5, "same"), (5, "same"), (2, ""), (9, None), (3, "x" * 100 + "a"), (4, "x" * 100 + "b"), (6, "x" * 100 + "a"),
        (None, "same"), (None, "lone"), (8, "Same")]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id bigint, text string, keep_id string, _len int")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        out.append((str(i), str(keep), len(ids), i == keep, ids.count(keep) if len(ids) > 1 else 1, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("keys", [1_000_000, 0])
def test_matches_brute_force(spark, monkeypatch, keys):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", keys)
    got = exact_dedup.exact_groups(table(spark), digest=True).collect()
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in got) == brute(ROWS)


@pytest.mark.parametrize("keys", [1_000_000, 0])
def test_keep_one_keeps_each_text_once_with_all_columns(spark, monkeypatch, keys):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", keys)
    docs = table(spark)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r[0]), r[1]) for r in kept.collect()) == sorted(
        [("5", "same"), ("6", "x" * 100 + "a"), ("4", "x" * 100 + "b"), ("9", None), ("None", "lone"), ("8", "Same")])


def test_full_hash_only_where_prefixes_meet(spark):
    got = exact_dedup.exact_groups(table(spark, [(1, "abc"), (2, "abd"), (3, "a")])).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(i, i, 1, True) for i in (1, 2, 3)}


def test_empty_table(spark):
    assert exact_dedup.exact_groups(table(spark, []), digest=True).count() == 0
    assert exact_dedup.keep_one(table(spark, [])).count() == 0
