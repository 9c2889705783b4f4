"""NumPy helpers that run inside Arrow tasks on one batch of vectors or codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..functions.vector import EPS

DECIMALS = 9  # scores are compared after rounding, so summation order cannot decide a rank
MARGIN = 2 * 10.0 ** -DECIMALS      # entries this close to a bound may round onto it
POSITIVE = 0.5 * 10.0 ** -DECIMALS  # scores above this are positive after rounding


def once(broadcast):
    """A broadcast value for one use in a worker, which doesn't keep it: it is read from the local copy again."""
    value = broadcast.value
    broadcast.__dict__.pop("_value", None)
    return value


def grouped(batches, limit: int):
    """Lists of Arrow batches of about `limit` bytes each."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def list_matrix(column, dtype=np.float64) -> np.ndarray:
    """Arrow list column of equal-length vectors -> (rows, dim)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) == 0:
        return np.zeros((0, 0), dtype)
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (lengths != lengths[0]).any():
        raise ValueError("vectors must be non-null and of one length")
    return values.reshape(len(column), -1).astype(dtype, copy=False)


def code_arrays(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrow column of packed codes -> (row offsets, feature ids, weights)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    entries = column.flatten()
    offsets = column.offsets.to_numpy()
    return (offsets - offsets[0],
            entries.field(0).to_numpy(zero_copy_only=False).astype(np.int64),
            entries.field(1).to_numpy(zero_copy_only=False).astype(np.float64))


def first_entries(offsets, features, weights, k: int):
    """The code of every row cut to its first k entries."""
    lengths = np.diff(offsets)
    position = np.arange(len(features)) - np.repeat(offsets[:-1], lengths)
    keep = position < k
    return (np.concatenate([[0], np.cumsum(np.minimum(lengths, k))]),
            features[keep], weights[keep])


def top_columns(scores: np.ndarray, k: int, floor: np.ndarray | None = None):
    """Exact k best entries of each row, ties to the lower column.

    -inf marks an entry that may not be chosen. Returns (rows, columns) ordered
    by row; entries below the row's `floor` are left out.
    """
    n, m = scores.shape
    k = min(k, m)
    if n == 0 or k == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kth = np.partition(scores, m - k, axis=1)[:, m - k][:, None]
    above = scores > kth
    tied = (scores == kth) & (scores > -np.inf)
    keep = above
    if tied.any():
        room = k - above.sum(axis=1, keepdims=True)
        keep = above | (tied & (np.cumsum(tied, axis=1) <= room))
    if floor is not None:
        keep &= scores >= floor[:, None]
    return np.nonzero(keep)


def where(mask: np.ndarray):
    """(rows, columns) of the true cells of a matrix of which few are true: eight cells are looked at together."""
    flat = np.ascontiguousarray(mask).reshape(-1)
    cut = len(flat) // 8 * 8
    word = np.flatnonzero(flat[:cut].view(np.uint64))
    place, byte = np.nonzero(flat[:cut].reshape(-1, 8)[word])
    cell = np.concatenate([word[place] * 8 + byte, np.flatnonzero(flat[cut:]) + cut])
    return np.divmod(cell, max(1, mask.shape[1]))


class RunningTopK:
    """Best k (score, id) per query over the batches one task has seen.

    New entries wait until there are half as many as the lists hold, so that the lists are cut anew only now and then.
    """

    def __init__(self, n_queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.n = n_queries
        self.query = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.key = np.zeros(0)
        self.score = np.zeros(0)
        self.floor = np.full(n_queries, -np.inf) if floor is None else floor.astype(np.float64)
        self.waiting, self.n_waiting = [], 0

    def _candidates(self, scores: np.ndarray, allowed: np.ndarray | None, floor: np.ndarray):
        """Entries that can still enter the lists, at least the k best new ones of each query."""
        if np.isfinite(floor).all():
            # lists are full: few entries reach the floor, and only those need rounding
            mask = scores >= (floor - MARGIN)[:, None]
            if allowed is not None:
                mask &= allowed
            if np.count_nonzero(mask) <= 4 * len(floor) * self.k:
                return where(mask)
        keys = np.round(scores, DECIMALS)
        if allowed is not None:
            keys[~allowed] = -np.inf
        return top_columns(keys, self.k, floor)

    def add(self, scores: np.ndarray, doc_ids: np.ndarray, allowed: np.ndarray | None = None,
            queries: np.ndarray | None = None) -> None:
        """`scores` is (queries, docs) with docs in ascending id order; `allowed` masks candidates; `queries`
        numbers the lines of `scores` where they are not all the queries."""
        floor = self.floor if queries is None else self.floor[queries]
        rows, cols = self._candidates(scores, allowed, floor)
        self.push(rows if queries is None else queries[rows], doc_ids[cols], scores[rows, cols])

    def push(self, rows: np.ndarray, docs: np.ndarray, fresh: np.ndarray) -> None:
        if len(rows):
            self.waiting.append((rows, docs, fresh))
            self.n_waiting += len(rows)
        if 2 * self.n_waiting >= self.n * self.k:
            self._cut()

    def settle(self) -> None:
        """Sort what waits into the lists; afterwards the floors are up to date."""
        self._cut()
        order = np.lexsort((self.doc, -self.key, self.query))
        self.query, self.doc, self.key, self.score = self.query[order], self.doc[order], self.key[order], self.score[order]

    def _cut(self) -> None:
        """Take what waits into the lists, which stay in no order."""
        if not self.waiting:
            return
        rows, docs, fresh = (np.concatenate(part) for part in zip(*self.waiting))
        self.waiting, self.n_waiting = [], 0
        keys = np.round(fresh, DECIMALS)
        reach = keys >= self.floor[rows]
        query = np.concatenate([self.query, rows[reach]])
        doc = np.concatenate([self.doc, docs[reach]])
        key = np.concatenate([self.key, keys[reach]])
        score = np.concatenate([self.score, fresh[reach]])
        lengths = np.bincount(query, minlength=self.n)
        if lengths.max(initial=0) >= self.k:
            keep = self._best(query, doc, key, lengths)
            query, doc, key, score = query[keep], doc[keep], key[keep], score[keep]
        self.query, self.doc, self.key, self.score = query, doc, key, score

    def _best(self, query, doc, key, lengths) -> np.ndarray:
        """Which entries are among the k best of their query, ties to the lower id; floors of full lists are raised."""
        order = np.argsort(query.astype(np.uint16) if self.n <= 1 << 16 else query, kind="stable")
        starts = np.cumsum(lengths) - lengths
        full = np.flatnonzero(lengths >= self.k)
        kth = np.full(self.n, -np.inf)
        sizes = lengths[full]
        for some in np.split(full[np.argsort(sizes)], np.flatnonzero(np.diff(np.sort(sizes) // self.k)) + 1):  # lists of like lengths
            step = max(1, (1 << 21) // int(lengths[some].max()))
            for at in range(0, len(some), step):
                mine = some[at:at + step]
                n = lengths[mine]
                line = np.repeat(np.arange(len(mine)), n)
                place = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
                grid = np.full((len(mine), int(n.max())), -np.inf)
                grid[line, place] = key[order[np.repeat(starts[mine], n) + place]]
                kth[mine] = np.partition(grid, grid.shape[1] - self.k, axis=1)[:, grid.shape[1] - self.k]
        self.floor = np.maximum(self.floor, kth)
        keep = key >= kth[query]
        over = (np.bincount(query[keep], minlength=self.n) > self.k)[query] & keep
        if over.any():  # more entries share the last key than there is room for
            tied = np.flatnonzero(over)
            tied = tied[np.lexsort((doc[tied], -key[tied], query[tied]))]
            q = query[tied]
            keep[tied[np.arange(len(q)) - np.searchsorted(q, q) >= self.k]] = False
        return keep


def single_slack(dim: int) -> float:
    """Largest error of a single-precision dot product of `dim` terms, as a share of both lengths."""
    unit = dim * 2.0 ** -24
    return 1.01 * unit / (1 - unit)


def _reaching(left: np.ndarray, right: np.ndarray, bound: np.ndarray):
    """(rows, columns) where the single-precision product reaches the row's bound."""
    low = bound.astype(np.float32)
    return where(left @ right.T >= (low - np.spacing(np.abs(low)))[:, None])


def _dots(left: np.ndarray, rows: np.ndarray, right: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Double dot products of the given pairs, a bounded number at a time."""
    step = max(1, (1 << 21) // max(1, left.shape[1]))
    out = [np.einsum("ij,ij->i", left[rows[a:a + step]], right[cols[a:a + step]].astype(np.float64, copy=False))
           for a in range(0, len(rows), step)]
    return np.concatenate(out) if out else np.zeros(0)


class DenseQueries:
    """A block of query vectors; scores are double, screened in single precision where that is safe.

    A single-precision dot product of dim n is off by at most n * 2^-24 * |q| * |d| (to first
    order), whatever the summation order. Entries below the floor by more than that cannot
    enter a list, so only the rest is computed in double.
    """

    def __init__(self, vectors: np.ndarray):
        self.single = vectors.astype(np.float32)
        self.double = vectors.astype(np.float64)
        self.exact_input = np.array_equal(self.single, self.double)
        self.slack = single_slack(vectors.shape[1]) * np.linalg.norm(self.double, axis=1)

    def offer(self, best: RunningTopK, docs: np.ndarray, doc_ids: np.ndarray) -> None:
        if self.exact_input and docs.dtype == np.float32 and np.isfinite(best.floor).all():
            longest = np.sqrt(np.einsum("ij,ij->i", docs, docs, dtype=np.float64).max(initial=0))
            rows, cols = _reaching(self.single, docs, best.floor - MARGIN - self.slack * longest)
            if len(rows) <= 4 * best.n * best.k:
                best.push(rows, doc_ids[cols], _dots(self.double, rows, docs, cols))
                return
        best.add(self.double @ docs.T.astype(np.float64), doc_ids)


class SparseQueries:
    """A block of query codes arranged by feature, ready to score document batches.

    Features that a code names twice count with the sum of their weights. `norms` are the lengths that a cosine
    divides by, those of the codes unless given.
    """

    DENSE_FEATURES = 2048  # up to so many used features a block is scored as a matrix
    MATRIX = 1 << 22       # numbers of such a matrix of queries

    def __init__(self, offsets, features, weights, norms=None):
        self.n = len(offsets) - 1
        rows = np.repeat(np.arange(self.n), np.diff(offsets))
        order = np.argsort(features, kind="stable")
        self.rows, self.weights = rows[order], weights[order]
        self.features, starts = np.unique(features[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.norms = np.sqrt(np.bincount(rows, weights * weights, self.n)) if norms is None else norms
        self.whole = len(self.features) <= self.DENSE_FEATURES and self.n * len(self.features) <= self.MATRIX
        self.sides = {}

    def dense(self, weights) -> np.ndarray:
        width = len(self.features)
        cells = self.rows * width + np.repeat(np.arange(width), np.diff(self.starts))
        return np.bincount(cells, weights, self.n * width).reshape(self.n, width)

    def _side(self, cosine: bool):
        """(double matrix, single matrix, slack of a single-precision score), the single one of unit length for a cosine."""
        if cosine not in self.sides:
            double = self.dense(self.weights)
            scaled = np.divide(double, self.norms[:, None], out=np.zeros_like(double),
                               where=self.norms[:, None] > 0) if cosine else double
            self.sides[cosine] = (double, scaled.astype(np.float32), np.linalg.norm(scaled, axis=1))
        return self.sides[cosine]

    def _match(self, offsets, features, weights):
        """Document entries whose feature some query uses."""
        docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        slot = np.searchsorted(self.features, features)
        slot[slot == len(self.features)] = 0
        hit = self.features[slot] == features
        return docs[hit], slot[hit], weights[hit]

    def offer(self, best: RunningTopK, offsets, features, weights, doc_ids, spec, norms=None, queries=None) -> None:
        """Score a batch of documents for the given queries, or all, and hand what can rank to their lists."""
        if norms is None:
            rows = np.repeat(np.arange(len(doc_ids)), np.diff(offsets))
            norms = np.sqrt(np.bincount(rows, weights * weights, len(doc_ids)))
        if not (self.whole and len(self.features) and len(doc_ids)):
            scores, overlap = self.score(offsets, features, weights, spec["candidates"] == "overlap")
            if queries is not None:
                scores, overlap = scores[queries], None if overlap is None else overlap[queries]
            self._add(best, scores, overlap, norms, doc_ids, spec, queries)
            return
        width = len(self.features)
        docs, slot, w = self._match(offsets, features, weights)
        block = np.bincount(docs * width + slot, w, len(doc_ids) * width).reshape(-1, width)
        mine = np.arange(self.n) if queries is None else queries
        mine = mine[~self._screened(best, block, norms, doc_ids, spec, mine)]
        if len(mine):  # lists that are not full, or that screening would not cut
            double = self._side(spec["scoring"] == "cosine")[0]
            overlap = None
            if spec["candidates"] == "overlap":
                present = np.zeros(block.shape, np.float32)
                present[docs, slot] = 1
                overlap = (self.dense(np.ones_like(self.weights)).astype(np.float32)[mine] @ present.T) > 0
            self._add(best, double[mine] @ block.T, overlap, norms, doc_ids, spec, mine)

    def _scale(self, norms, spec):
        return norms + EPS if spec["epsilon"] == "add" else np.maximum(norms, EPS)

    def _add(self, best, scores, overlap, norms, doc_ids, spec, queries):
        if spec["scoring"] == "cosine":
            own = self.norms if queries is None else self.norms[queries]
            scores = scores / self._scale(own[:, None] * norms[None, :], spec)
        best.add(scores, doc_ids, scores > POSITIVE if spec["candidates"] == "positive" else overlap, queries)

    def _screened(self, best, block, norms, doc_ids, spec, mine) -> np.ndarray:
        """Which of the queries `mine` were served by a single-precision screen against their floors.

        A list must be full, and unless documents without a shared feature may rank, its floor above zero, which no
        such document reaches. A cosine is screened as the product of unit vectors, its guard against zero being part of the slack.
        """
        cosine = spec["scoring"] == "cosine"
        double, single, long = self._side(cosine)
        floor = best.floor[mine]
        served = np.isfinite(floor) if spec["candidates"] == "all" else floor > 0
        scaled = np.divide(block, norms[:, None], out=np.zeros_like(block), where=norms[:, None] > 0) if cosine else block
        longest = np.sqrt(np.einsum("ij,ij->i", scaled, scaled).max(initial=0))
        if not served.any() or not long.max(initial=0) * longest < 1e30:
            return np.zeros(len(mine), bool)
        slack = single_slack(block.shape[1] + 8) * long[mine] * longest
        if cosine:
            least = norms[norms > 0].min(initial=np.inf)
            guard = np.where(self.norms[mine] > 0, EPS / (self.norms[mine] * least + EPS), 0)
            slack = slack + 2 * guard * long[mine] * longest
        rows = mine[served]
        found, cols = _reaching(single if len(rows) == self.n else single[rows], scaled.astype(np.float32), (floor - MARGIN - slack)[served])
        if len(found) > 4 * len(rows) * best.k:
            return np.zeros(len(mine), bool)
        found = rows[found]
        exact = _dots(double, found, block, cols)
        if cosine:
            exact = exact / self._scale(self.norms[found] * norms[cols], spec)
        keep = exact >= best.floor[found] - MARGIN
        if spec["candidates"] == "positive":
            keep &= exact > POSITIVE
        best.push(found[keep], doc_ids[cols[keep]], exact[keep])
        return served

    def score(self, offsets, features, weights, need_overlap: bool):
        """(scores, overlap mask or None) of all queries against a batch of documents."""
        n_docs = len(offsets) - 1
        shape = (self.n, n_docs)
        if len(self.features) == 0 or n_docs == 0:
            return np.zeros(shape), (np.zeros(shape, bool) if need_overlap else None)
        docs, slot, weights = self._match(offsets, features, weights)
        scores = np.zeros(shape[0] * shape[1])
        overlap = np.zeros(len(scores), bool) if need_overlap else None
        fanout = np.diff(self.starts)[slot]
        step_ends = np.cumsum(fanout)
        begin = 0
        while begin < len(slot):  # bounded expansion: a few million products at a time
            base = step_ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(step_ends, base + 4_000_000, "right")))
            count = fanout[begin:end]
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            entry = np.repeat(self.starts[slot[begin:end]], count) + inner
            cell = self.rows[entry] * n_docs + np.repeat(docs[begin:end], count)
            np.add.at(scores, cell, self.weights[entry] * np.repeat(weights[begin:end], count))
            if need_overlap:
                overlap[cell] = True
            begin = end
        return scores.reshape(shape), None if overlap is None else overlap.reshape(shape)
