import itertools
import random

import numpy as np
import pytest

from sparkvec.llm import simhash
from sparkvec.llm.components import components

SCHEMA = "doc_id bigint, text string, component_id string, fp string"


def brute_print(text, words):
    import re

    import xxhash
    found = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if not found:
        return 0
    runs = [b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, bits):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def corpus():
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma", "délta", "epsilon", "zeta\x0b", "Ünder", "ITEM", "x y"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(30, 400))) for _ in range(40)]
    texts = ["", None, "   \n", "one", "ONE", "one two three", *base]
    for text in base:
        parts = text.split(" ")
        for _ in range(r.randint(0, 4)):
            copy = list(parts)
            copy[r.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize("words,bits,chunk", [(4, 4, 4096), (5, 6, 3)])
def test_matches_brute_force(spark, monkeypatch, words, bits, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in simhash.near_groups(docs, words, bits).collect()}
    prints = {i: brute_print(t or "", words) for i, t in rows}
    assert {i: got[i]["fp"] % (1 << 64) for i in prints} == prints
    assert {i: got[i]["component_id"] for i in prints} == brute_groups(prints, bits)


def test_large_cells_and_every_number_of_blocks(spark, monkeypatch):
    r = random.Random(5)
    centre = r.getrandbits(64)
    prints = {i: centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for i in range(300)}
    prints.update({1000 + i: r.getrandbits(64) for i in range(300)})
    prints = {i: p for i, p in prints.items() if p not in {prints[j] for j in prints if j < i}}
    frame = spark.createDataFrame([([p - (1 << 64) if p >> 63 else p], i) for i, p in prints.items()], "fp array<bigint>, node bigint")
    want = brute_groups(prints, 3)
    monkeypatch.setattr(simhash, "CHUNK", 50)
    for blocks in (4, 5, 6):
        masks = [(0, m) for m in simhash.block_masks(blocks, blocks - 3)]
        roots = {x["node"]: x["root"] for x in components(simhash.links(frame, 3, masks)).collect()}
        assert {i: roots.get(i, i) for i in prints} == want


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (None, "only here"), (7, None)], "doc_id bigint, text string")
    got = sorted((str(x[0]), str(x[2])) for x in simhash.near_groups(docs, 4, 0).collect())
    assert got == [("3", "3"), ("3", "3"), ("7", "7"), ("None", "3"), ("None", "None")]
    assert simhash.near_groups(docs.limit(0), 4, 4).count() == 0


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, text, "x"), (2, text + " w", "y"), (3, "other words here", "z")], "doc_id bigint, text string, more string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 3]


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_fingerprint_counts_are_exact():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 70_000, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.fingerprint(hashes).tolist() == [want]


BASE = " ".join(f"w{i}" for i in range(400))
OTHER = " ".join(f"o{i}" for i in range(300))


@pytest.mark.parametrize("rows,want", [
    ([(1, BASE), (2, BASE + " w"), (2, OTHER)], [(1, BASE), (2, OTHER)]),  # an id that names two texts
    ([(2, OTHER), (2, BASE + " w"), (1, BASE)], [(1, BASE), (2, OTHER)]),
    ([(1, OTHER), (1, BASE), (2, BASE + " w"), (0, OTHER + " o")], [(0, OTHER + " o"), (1, BASE)]),
    ([(None, BASE), (5, BASE + " w"), (None, OTHER)], [(5, BASE + " w"), (None, OTHER)]),
    ([(3, BASE), (3, BASE), (4, None), (7, ""), (4, None)], [(3, BASE), (4, None)]),
    ([(3, BASE + " w"), (3, BASE + " w"), (2, BASE)], [(2, BASE)]),
])
def test_keep_one_with_repeated_and_missing_ids(spark, rows, want):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, part int, key string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted((str(i), str(t)) for i, t in want)


def test_one_of_near_copies_without_ids_stays(spark):
    docs = spark.createDataFrame([(None, BASE), (None, BASE + " w"), (None, OTHER)], "doc_id bigint, text string")
    got = [r["text"] for r in simhash.keep_one(docs).collect()]
    assert len(got) == 2 and OTHER in got
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame([("b", BASE), ("a", BASE + " w")], "doc_id string, text string")).collect()) == ["a"]


def test_similar_groups_against_exact_similarity(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, sets = [], {}
    for k in range(120):
        base = [r.choice(vocabulary) for _ in range(r.randint(120, 600))]
        for copy, share in enumerate((0, 0.002, 0.01, 0.08)):
            words = [w if r.random() > share else "x" + w for w in base]
            rows.append((10 * k + copy, " ".join(words)))
    rows += [(5000 + i, rows[0][1] + f" tail{i}") for i in range(60)]
    for i, text in rows:
        words = text.split()
        sets[i] = {tuple(words[j:j + 5]) for j in range(len(words) - 4)}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    group = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs).collect()}
    close = far = missed = 0
    for a, b in itertools.combinations(sorted(sets), 2):
        likeness = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if likeness >= 0.88:
            close += 1
            missed += group[a] != group[b]
        if likeness < 0.2:
            far += group[a] == group[b]
    assert close > 1800 and missed <= 0.01 * close and far == 0
    kept = {x["doc_id"] for x in simhash.keep_one(docs).collect()}
    assert kept == {i for i in group if group[i] == i}


def near_threshold_corpus(levels=(0.74, 0.77, 0.79, 0.802, 0.82, 0.85), pairs=60, size=300):
    """Pairs of texts at planned similarities: a changed run of words in the middle of a long text costs shingles exactly."""
    r = random.Random(17)
    rows = []
    for level in levels:
        for _ in range(pairs):
            words = [f"v{r.randrange(10 ** 6)}" for _ in range(size)]
            shingles = size - 4
            other = list(words)
            lost = round(shingles * (1 - level) / (1 + level))  # both texts lose as many
            run = r.randrange(size - lost - 4)
            other[run + 4:run + 4 + max(1, lost - 4)] = [f"z{r.randrange(10 ** 6)}" for _ in range(max(1, lost - 4))]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    return rows


def exact_groups(rows, words=5, similarity=0.8):
    sets = {}
    for i, text in rows:
        found = (text or "").lower().split()
        sets[i] = {tuple(found[j:j + words]) for j in range(max(1, len(found) - words + 1))} if found else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a]) and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9 or sets[a] == sets[b]:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("members", [256, 4])
def test_recall_and_precision_at_the_similarity(spark, monkeypatch, members):
    monkeypatch.setattr(simhash, "MEMBERS", members)
    rows = near_threshold_corpus()
    n = len(rows)
    short = "a b c d e f g h i"  # five shingles, and four of them
    rows += [(n, short), (n + 1, short[:-2]), (n + 2, ""), (n + 3, None), (n + 4, short + " " + short), (n + 5, "one"), (n + 6, "ONE")]
    repeated = " ".join(f"r{i}" for i in range(30))
    rows += [(n + 10, repeated), (n + 11, f"{repeated} {repeated}"), (n + 12, " ".join([repeated] * 40))]
    r = random.Random(2)
    base = [f"c{i}" for i in range(200)]
    for k in range(40):  # a group that only some of its pairs hold together
        words = list(base)
        for _ in range(6):
            words[r.randrange(200)] = f"y{r.randrange(10 ** 6)}"
        rows.append((n + 100 + k, " ".join(words)))
    want = exact_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs).collect()}
    assert got == want
    linked = sum(want[i] == want[i + 1] for i in range(0, n, 2))
    assert n // 8 < linked < n // 2 - n // 8


def test_bands_and_bound_lose_less_than_one_pair_in_a_thousand_at_the_similarity():
    r = np.random.default_rng(4)
    count, bits, lost = simhash.band_count(0.8, 1 - 1e-7), simhash.candidate_bits(0.8, 256), 0
    for k in range(2000):
        shared = int(r.choice([4, 8, 40, 160]))
        x = np.unique(r.integers(0, 1 << 64, shared * 5 // 4, dtype=np.uint64))
        a, b = (x, x[:shared]) if k % 2 else (x[shared // 8:], x[:len(x) - (len(x) - shared - shared // 8)])
        met = (simhash.bands(a, count) == simhash.bands(b, count)).any()
        far = np.bitwise_count(simhash.fingerprint(a, 4) ^ simhash.fingerprint(b, 4)).sum() > bits
        lost += not met or far
    assert lost <= 1
