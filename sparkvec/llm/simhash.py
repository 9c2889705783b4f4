"""SimHash fingerprints, and links between fingerprints that differ in few bits.

Fingerprints are cut into blocks. Two that differ in at most `bits` bits agree in all but `bits`
blocks, so they meet under at least one choice of that many agreeing blocks; distances are verified
where they meet. Choices with many members are split into cells that pairs of chunks share.

Groups by Jaccard similarity use longer fingerprints only to find candidates; each of their links is
verified on the texts' exact sets of shingles.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, releasing, slices, small_batches, store, text_of, texts, widen
from .components import components

SEED = 42
# Members of one chunk of a bucket; a cell holds two chunks at most.
CHUNK = 4096
# Ids that are broadcast at most.
BROADCAST_IDS = 1_000_000
# Mean bucket size at which one more block is cut.
BUCKET = 64
# Minima that one band of a text joins.
ROWS = 3
# Texts, and shingles, of one chunk of a group of candidates; a cell holds two chunks at most.
MEMBERS = 256
SHINGLES = 1_000_000
# Largest expected share of differing bits at 0.8: five shingles against four of them; long texts have 0.15.
SHORT_SHARE = 3 / 16


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `words` words (ASCII lower case), repeats included; of all words if they are fewer."""
    import xxhash
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = (ends[:-words] if words else ends).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip([0, *starts], (ends[words - 1:] - 1).tolist())], np.uint64)


def lane(hashes: np.ndarray, number: int) -> np.ndarray:
    """Hashes for a further 64 bits of a fingerprint: lane 0 is the hash itself, others are mixed from it."""
    if not number:
        return hashes
    x = hashes + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """64 bits a lane: a bit is set if more than half of the lane's hashes have it; no hashes give zero."""
    ones = np.zeros((lanes, 64), np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start:start + (1 << 14)]
        for k in range(lanes):
            bits = np.unpackbits(lane(part, k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text", lanes: int = 1) -> DataFrame:
    """`id_col`, fp (one signed long a lane). Null and empty texts have fingerprint zero."""
    small_batches(docs.sparkSession)
    rows = widen(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).withColumn("text", text_of())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.concatenate([fingerprint(shingle_hashes(t, words), lanes) for t in texts(batch, "text")])
        offsets = np.arange(0, len(made) + 1, lanes, dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("id"), lists], [id_col, "fp"])
    return map_texts(rows, "text", run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp array<bigint>")


def block_masks(blocks: int, agree: int) -> list[int]:
    """A signed mask for each choice of `agree` of `blocks` blocks of 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(choice) for choice in itertools.combinations(single, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def choose_blocks(count: int, bits: int) -> int:
    """Fewest blocks at which a bucket of evenly spread fingerprints has no more than BUCKET members."""
    blocks = bits + 1
    while blocks < bits + 6 and count / 2 ** (64 * (blocks - bits) // blocks) > BUCKET:
        blocks += 1
    return blocks


def bands(hashes: np.ndarray, count: int) -> np.ndarray:
    """`count` values of distinct hashes, each of ROWS minima under drawn permutations: two sets agree in one with
    probability Jaccard ** ROWS. An empty set has none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    r = np.random.default_rng(SEED)
    flip, odd = r.integers(0, 1 << 64, (2, ROWS * count, 1), dtype=np.uint64)
    odd |= np.uint64(1)
    least = np.full(ROWS * count, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 1 << 12):
        x = (hashes[start:start + (1 << 12)] ^ flip) * odd
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * odd).min(axis=1))
    out = np.zeros(count, np.uint64)
    for part in least.reshape(count, ROWS).T:
        out = lane(out ^ part, 1)
    return out


def band_count(similarity: float, recall: float) -> int:
    """Bands at which two sets of this similarity agree in one with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** ROWS)) if similarity < 1 else 1


def candidate_bits(similarity: float, bits: int) -> int:
    """Differing bits of `bits` that a pair of this similarity exceeds with a probability under one in a million:
    five standard deviations above the mean."""
    share = min(0.5, differing_share(similarity) * SHORT_SHARE / differing_share(0.8))
    return math.ceil(bits * share + 5 * math.sqrt(bits * share * (1 - share)))


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two sets with this Jaccard similarity: their angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32)


def _near(group: np.ndarray, nodes: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links in one cell: each member is compared with those not yet reached."""
    a, b = [], []
    left = np.arange(len(group))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            p = queue.pop()
            hit = _distance(group[left], group[p]) <= bits
            if hit.any():
                reached = left[hit]
                a.append(np.full(len(reached), nodes[p]))
                b.append(nodes[reached])
                queue += reached.tolist()
                left = left[~hit]
    return a, b


def cell_links(starts: np.ndarray, ends: np.ndarray, group: np.ndarray, nodes: np.ndarray, bits: int):
    """Links of consecutive cells [start, end): small cells at once by offset, large ones as forests."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    small = (ends - starts > 1) & (ends - starts <= 24)
    at = np.concatenate([np.arange(s, e) for s, e in zip(starts[small], ends[small])]) if small.any() else np.empty(0, np.int64)
    last = np.repeat(ends[small], (ends - starts)[small])
    for step in range(1, 24):
        keep = at + step < last
        at, last = at[keep], last[keep]
        if not len(at):
            break
        hit = at[_distance(group[at], group[at + step]) <= bits]
        a.append(nodes[hit])
        b.append(nodes[hit + step])
    for s, e in zip(starts[ends - starts > 24], ends[ends - starts > 24]):
        more = _near(group[s:e], nodes[s:e], bits)
        a += more[0]
        b += more[1]
    empty = [np.empty(0, np.int64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


def links(prints: DataFrame, bits: int, masks: list[tuple[int, int]], lanes: int = 1) -> DataFrame:
    """Links between distinct fingerprints that agree under one of the masks and differ in at most `bits` bits.

    `prints` has fp and node, one row per fingerprint. Returns u, v: nodes of pairs within `bits` bits. Within
    a cell it is a spanning forest of the links, so the components are those of all links, and
    no group of n close fingerprints gives n squared rows. Buckets over CHUNK members are dealt to
    cells of two chunks each, so that every pair of members meets in one.
    """
    choices = F.array(*[F.struct(F.lit(k).alias("lane"), F.lit(m).cast("long").alias("mask")) for k, m in masks])
    members = prints.select("fp", "node", F.posexplode(choices).alias("choice", "by"))
    value = F.element_at("fp", F.col("by.lane") + 1).bitwiseAND(F.col("by.mask"))
    return _cell_links(members.select("choice", value.alias("bucket"), "node", "fp"), bits, lanes)


def _cell_links(members: DataFrame, bits: int, lanes: int) -> DataFrame:
    """Links in the buckets (choice, bucket) of node, fp; see `links`."""
    hot = store(members.groupBy("choice", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK), "hot-buckets")
    fits = hot.count() <= BROADCAST_IDS
    members = members.join(F.broadcast(hot) if fits else hot, ["choice", "bucket"], "left")
    chunks = F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    cells = members.withColumn("mine", mine).select(
        "choice", "bucket", "fp", "node", "mine", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    order = ["choice", "bucket", "low", "high"]
    parts = [F.element_at("fp", k + 1).alias(f"f{k}") for k in range(lanes)]
    cells = cells.select("choice", "bucket", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "node", *parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if kept is None:
                    return
                columns, final = kept, True
            else:
                columns, final = [c.to_numpy(zero_copy_only=False) for c in batch.columns], False
                if not len(columns[0]):
                    continue
                if kept is not None:
                    columns = [np.concatenate(p) for p in zip(kept, columns)]
            new = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
            starts = np.concatenate([[0], 1 + np.flatnonzero(new)])
            ends = np.append(starts[1:], len(columns[0]))
            if not final:
                kept = [c[starts[-1]:] for c in columns]
                starts, ends = starts[:-1], ends[:-1]
            u, v = cell_links(starts, ends, np.stack(columns[5:], axis=1).view(np.uint64), columns[4], bits)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    return cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(releasing(run), "u bigint, v bigint")


def near_groups(docs: DataFrame, words: int = 5, bits: int = 4, id_col: str = "doc_id", text_col: str = "text",
                blocks: int | None = None) -> DataFrame:
    """Groups of texts whose 64-bit fingerprints are linked, directly or through others: exact for `bits`.

    Returns one row per input row: `id_col`, fp, component_id (the smallest id of the group). Null and empty
    texts share fingerprint zero and are linked like any other; equal fingerprints are one group;
    repeated rows give repeated results; a row without an id takes the component of its
    fingerprint, null if no row with that fingerprint has an id. Ids must be integers. An empty table
    gives an empty result. Texts stay in the scan; what moves are ids and fingerprints.
    """
    def masks(count: int) -> list[tuple[int, int]]:
        cut = blocks or choose_blocks(count, bits)
        return [(0, m) for m in block_masks(cut, cut - bits)]
    return _groups(docs, words, bits, 1, masks, id_col, text_col).withColumn("fp", F.element_at("fp", 1))


def digest(hashes: np.ndarray) -> bytes:
    """Names a set of distinct sorted hashes."""
    import hashlib
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()


def _sketched(rows: DataFrame, words: int, lanes: int, count: int) -> DataFrame:
    """id, key, set (digest of the distinct shingles), n (their number), fp and bands of every row of id, key, text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, words)) for t in texts(batch, "text")]
        made = [pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([fingerprint(s, lanes).view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([bands(s, count).view(np.int64) for s in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *made], ["id", "key", "set", "n", "fp", "bands"])
    kind = rows.schema["id"].dataType.simpleString()
    return map_texts(rows, "text", run, f"id {kind}, key bigint, set binary, n bigint, fp array<bigint>, bands array<bigint>")


def verified_forest(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs whose sets have this Jaccard similarity: each member is compared with those not yet reached."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    terms, member = np.unique(np.concatenate(sets), return_inverse=True)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left = np.arange(len(nodes))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            p = queue.pop()
            mine = np.zeros(len(terms), np.int64)
            mine[member[starts[p]:starts[p] + sizes[p]]] = 1
            both = np.add.reduceat(mine[member], starts)[left]
            hit = both / (sizes[left] + sizes[p] - both) >= similarity
            reached = left[hit]
            a.append(np.full(len(reached), nodes[p]))
            b.append(nodes[reached])
            queue += reached.tolist()
            left = left[~hit]
    return np.concatenate(a), np.concatenate(b)


def _verified_links(cells: DataFrame, similarity: float) -> DataFrame:
    """Verified links in cells (root, low, high) of node, shingles (packed hashes), at most two chunks in each."""
    order = ["root", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(cell: dict) -> pa.RecordBatch:
            u, v = verified_forest(np.array(list(cell)), [np.frombuffer(s, "<u8") for s in cell.values()], similarity)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        key, cell = None, {}
        for batch in batches:
            for *at, node, packed in zip(*[batch.column(c).to_pylist() for c in (*order, "node", "shingles")]):
                if at != key:
                    if len(cell) > 1:
                        yield made(cell)
                    key, cell = at, {}
                cell[node] = packed
        if len(cell) > 1:
            yield made(cell)
    cells = cells.select(*order, "node", "shingles").repartition(*order).sortWithinPartitions(*order)
    return cells.mapInArrow(releasing(run), "u bigint, v bigint")


def _packed(met: DataFrame, words: int) -> DataFrame:
    """root, chunks, mine, node, shingles of the rows whose text has the wanted set; of repeated rows a task gives one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                part = part.filter(pa.array([n not in given for n in part.column("node").to_pylist()], pa.bool_()))
                sets = [np.unique(shingle_hashes(t, words)) for t in texts(part, "text")]
                right = pa.array([digest(s) == w for s, w in zip(sets, part.column("set").to_pylist())], pa.bool_())
                given.update(part.filter(right).column("node").to_pylist())
                packed = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
                names = ["root", "chunks", "mine", "node"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], packed], [*names, "shingles"]).filter(right)
    return met.mapInArrow(releasing(run), "root bigint, chunks int, mine int, node bigint, shingles binary")


def _similar_links(rows: DataFrame, sets: DataFrame, candidates: DataFrame, words: int, similarity: float) -> DataFrame:
    """Verified links that join all similar sets within each group of candidates (node, root).

    First each chunk of a group is searched together with the group's first member, so a group of copies of one
    text is joined in linear work. Only groups that this leaves in parts have every pair of chunks searched.
    """
    known = sets.select("node", "set", "n", "at").join(candidates, "node")
    totals = known.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("chunks"))
    wanted = known.join(totals, "root").select("root", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("mine"), "node", "set", "at")
    wanted = store(wanted, "candidates")
    fits = wanted.count() <= BROADCAST_IDS
    met = rows.join(F.broadcast(wanted) if fits else wanted, rows["key"] == wanted["at"]).select("root", "chunks", "mine", "node", "set", "text")
    packed = store(_packed(met, words), "shingle-sets")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    near = packed.withColumn("low", F.explode(F.when(F.col("node") == F.col("root"), every).otherwise(F.array("mine"))))
    first = store(_verified_links(near.withColumn("high", F.col("low")), similarity), "verified")
    if wanted.where("chunks > 1").isEmpty():
        return first
    found = wanted.where("chunks > 1").select("root", "node").join(components(first).withColumnRenamed("root", "part"), "node", "left")
    open_ = store(found.groupBy("root").agg(F.min(F.coalesce("part", "node")).alias("least"), F.max(F.coalesce("part", "node")).alias("most"))
                  .where("least <> most").select("root"), "open-candidates")
    far = packed.join(open_, "root", "left_semi").withColumn("other", F.explode(every))
    far = far.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    return first.union(store(_verified_links(far, similarity), "verified-far"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, text of every row: the key names the row by its id and its text."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.select("id", F.xxhash64("id", "text").alias("key"), "text")


def _similar(docs: DataFrame, words: int, similarity: float, lanes: int, recall: float, id_col: str, text_col: str) -> DataFrame:
    """id, key, fp, component_id and part (a number of the group) of every row; see `similar_groups`.

    What is linked are sets of shingles under numbers of their own, so neither a repeated id nor a missing one
    confuses two texts.
    """
    small_batches(docs.sparkSession)
    rows = _keyed(widen(docs), id_col, text_col)
    marked = store(_sketched(rows, words, lanes, band_count(similarity, recall)), "fingerprints")
    sets = marked.groupBy("set").agg(F.min("id").alias("least"), F.min("key").alias("at"), F.first("n").alias("n"), F.first("fp").alias("fp"),
                                     F.first("bands").alias("bands"))
    sets = store(sets.withColumn("node", F.monotonically_increasing_id()), "sets")  # numbered once, as it is written
    members = sets.select(F.posexplode("bands").alias("choice", "bucket"), "node", "fp")
    candidates = components(_cell_links(members, candidate_bits(similarity, 64 * lanes), lanes))
    roots = components(_similar_links(rows, sets, candidates, words, similarity))
    groups = store(sets.select("set", "node", "least").join(roots, "node", "left").select(
        "set", "least", F.coalesce("root", "node").alias("part")), "parts")
    # only groups of several sets need their smallest id looked up
    several = groups.groupBy("part").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = groups.join(several.withColumnRenamed("component_id", "other"), "part", "left").select(
        "set", "part", F.coalesce("other", "least").alias("component_id"))
    return marked.select("id", "key", "fp", "set").join(store(groups, "components"), "set").drop("set")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 4, recall: float = 1 - 1e-7,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are linked, directly or through others, by a Jaccard similarity of `similarity` or more
    of their sets of shingles.

    Candidates agree in a band of minima, which a pair at the similarity does with probability `recall` and more
    similar ones more surely, and their fingerprints of `lanes` times 64 bits differ in no more than
    `candidate_bits`. Every link is then verified on the exact sets, so no dissimilar texts are
    linked by themselves. Fingerprints are those of distinct shingles. Texts without words, null ones among them, are one
    group. component_id is the smallest id of the group, null if none of its rows has an id. An id may name several
    texts; each has the group of its own text. Repeated rows give repeated results, an empty table an empty
    one. Texts stay in the scan; what moves are sketches, and the shingle hashes of texts that have a candidate.
    """
    found = _similar(docs, words, similarity, lanes, recall, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def _groups(docs: DataFrame, words: int, bits: int, lanes: int, masks, id_col: str, text_col: str) -> DataFrame:
    marked = store(fingerprints(docs, words, id_col, text_col, lanes), "fingerprints")
    prints = store(marked.groupBy("fp").agg(F.min(id_col).alias("node")), "prints")
    named = prints.where("node is not null").select("fp", F.col("node").cast("long").alias("node"))
    roots = components(links(named, bits, masks(prints.count()), lanes))
    named = store(prints.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")), "components")
    return marked.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts, with all its columns: the one with the smallest id.

    Rows are judged by id and text together: where one id names two texts, the one that has a near copy with a smaller id goes
    and the other stays. Of rows with one id in a group the one with the smaller hash stays, of rows alike one; rows
    without an id go before any that has one, and one of them stays if none has. Null and empty texts are one group. An empty table stays empty.
    """
    found = store(_similar(docs, words, similarity, 4, 1 - 1e-7, id_col, text_col).select("id", "key", "part"), "judged")
    first = found.groupBy("part").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first"), F.count(F.lit(1)).alias("n"))
    several = store(first.where("n > 1").select("part", F.col("first.id").alias("keep_id"), F.col("first.key").alias("keep_key")), "several")
    fits = several.count() <= BROADCAST_IDS
    met = found.join(F.broadcast(several) if fits else several, "part")
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key"))
    verdicts = store(met.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(
        F.min(stays).alias("_stays"), F.count(F.lit(1)).alias("_n")).where("not _stays or _n > 1"), "verdicts")
    fits = verdicts.count() <= BROADCAST_IDS  # beyond it both sides are shuffled
    key = F.xxhash64(docs[id_col], F.coalesce(docs[text_col], F.lit("")))
    same = docs[id_col].eqNullSafe(verdicts["_id"]) & (key == verdicts["_key"])
    alone = docs.join(F.broadcast(verdicts) if fits else verdicts, same, "left_anti")
    again = verdicts.where("_stays")
    if again.isEmpty():
        return alone
    # rows that are there several times, columns other than id and text aside: one of each
    name = max(docs.columns, key=len) + "_"
    one = docs.join(F.broadcast(again) if fits else again, same, "left_semi").withColumn(name, key).dropDuplicates([id_col, name]).drop(name)
    return alone.unionByName(one)
