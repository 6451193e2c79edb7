"""Exact nearest vectors over Arrow batches: products in single precision name the candidates, double precision decides.

A block of queries and one of items are multiplied as matrices of unit vectors. What may be among the k best by that, with
the most that single precision can err, is scored again in double precision in the order of the vector's places, as
``retrieve.cosine`` does. So no pair is left out, and scores and ties do not depend on how the rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and items of a block, and pairs that are scored again at once; so blocks stay in the processor's caches.
HIGH, WIDE, AGAIN = 256, 2048, 4096
#: Lengths of vectors between which their squares are normal numbers.
TINY, HUGE = 1e-140, 1e140


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of a and b, summed from the first place to the last."""
    return np.add.accumulate(a * b, axis=1)[:, -1] + 0.0


def rounded(score: np.ndarray) -> np.ndarray:
    """To nine places, halves away from zero."""
    size = np.abs(score) * 1e9
    whole = np.floor(size)
    return np.copysign(whole + (size - whole >= 0.5), score) / 1e9


def smallest(ids: pa.Array, k: int) -> pa.Array:
    return ids.take(pc.array_sort_indices(ids, null_placement="at_start")[:k])


class Vectors:
    """Vectors of one width with a length, and their rows. ``odd`` are those whose products single precision cannot bound."""

    def __init__(self, rows: np.ndarray, matrix: np.ndarray):
        norms = np.sqrt(dots(matrix, matrix))
        some = norms != 0
        self.rows, self.matrix, self.norms = rows[some], matrix[some], norms[some]
        unit = (self.matrix / self.norms[:, None]).astype(np.float32)
        self.odd = ~((self.norms > TINY) & (self.norms < HUGE) & np.isfinite(unit).all(axis=1))
        unit[self.odd] = 0
        self.unit = unit


def by_width(column: pa.Array) -> dict[int, Vectors]:
    """Vectors that have a score with others of their width; null ones, those with a null and those without length have none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    found = {}
    for width in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == width)
        values = column.take(pa.array(rows)).flatten()
        whole = ~values.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
        matrix = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        found[width] = Vectors(rows[whole], matrix[whole])
    return found


class Block:
    """The k best items so far of at most HIGH queries of one width."""

    def __init__(self, queries: Vectors, part: slice, k: int, threshold: float | None, none: pa.Array):
        self.rows, self.matrix, self.norms, self.unit, self.odd = (x[part] for x in (queries.rows, queries.matrix, queries.norms, queries.unit, queries.odd))
        self.k, self.threshold = k, threshold
        # Most that a product errs: a unit for each place and rounding; and a unit of the ninth place for ties.
        self.slack = (self.matrix.shape[1] + 8) * 2.0**-24 + 2e-9
        self.floor = np.full(len(self.rows), -np.inf if threshold is None else threshold - self.slack, np.float32)
        self.q, self.score, self.ids = np.empty(0, np.int64), np.empty(0), none
        self.waiting: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def search(self, items: Vectors, ids: pa.Array) -> None:
        for start in range(0, len(items.rows), WIDE):
            part = slice(start, start + WIDE)
            near = self.unit @ items.unit[part].T
            odd = self.odd[:, None] | items.odd[None, part]
            any_odd = bool(odd.any())
            floor = self.floor
            at = np.flatnonzero(near >= floor[:, None])
            if len(at) > 4 * self.k * len(self.rows) and near.shape[1] > self.k:
                sure = np.where(odd, np.float32(-np.inf), near) if any_odd else near
                kth = np.partition(sure, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k]
                floor = np.maximum(floor, kth - np.float32(2 * self.slack))
                at = np.flatnonzero(near >= floor[:, None])
            if any_odd:
                at = np.flatnonzero((near >= floor[:, None]) | odd)
            for first in range(0, len(at), AGAIN):
                q, i = np.divmod(at[first : first + AGAIN], near.shape[1])
                self._score(q, i + start, items, ids)
            if sum(len(q) for q, _, _ in self.waiting) > len(self.q) // 2:
                self.settle()

    def _score(self, q: np.ndarray, i: np.ndarray, items: Vectors, ids: pa.Array) -> None:
        score = dots(self.matrix[q], items.matrix[i]) / (self.norms[q] * items.norms[i])
        keep = ~(score < (self.floor[q] if self.threshold is None else np.maximum(self.floor[q], self.threshold)))
        self.waiting.append((q[keep], score[keep], ids.take(pa.array(items.rows[i[keep]]))))

    def settle(self) -> None:
        """Keeps the k best of each query, ties by item."""
        if not self.waiting:
            return
        q, score = (np.concatenate([x, *[w[n] for w in self.waiting]]) for n, x in enumerate((self.q, self.score)))
        ids = pa.concat_arrays([self.ids, *[w[2] for w in self.waiting]])
        self.waiting = []
        key = np.where(np.isnan(score), np.inf, rounded(score))
        order = np.lexsort((pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy(), -key, q))
        sorted_q = q[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
        last = order[place == self.k - 1]
        self.floor[q[last]] = np.where(np.isnan(score[last]), np.inf, score[last] - self.slack)
        order = order[place < self.k]
        self.q, self.score, self.ids = q[order], score[order], ids.take(pa.array(order))


def nearest(shared, k: int, threshold: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (item, vector) against a broadcast table of (query, vector) -> query_id, item_id, score and key, the
    score rounded for ranking: of each partition the k best items of every query. Without a threshold, items without a
    score fill up what is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(all="ignore")
        table = shared.value.combine_chunks()
        if not table.num_rows:
            return
        queries, vectors = (c.chunk(0) for c in table.columns)
        groups, blocks, nulls = by_width(vectors), {}, {}
        blank = np.setdiff1d(np.arange(len(queries)), np.concatenate([np.empty(0, np.int64), *[g.rows for g in groups.values()]]))
        for batch in batches:
            ids = batch.column(0)
            if not blocks:
                blocks = {w: [Block(g, slice(n, n + HIGH), k, threshold, ids[:0]) for n in range(0, len(g.rows), HIGH)] for w, g in groups.items()} | {0: []}
                nulls = {w: ids[:0] for w in blocks}
            items = by_width(batch.column(1))
            for w in blocks:
                for block in blocks[w] if w in items else ():
                    block.search(items[w], ids)
                if threshold is None:
                    without = np.setdiff1d(np.arange(len(ids)), items[w].rows) if w in items else np.arange(len(ids))
                    if len(without):
                        nulls[w] = smallest(pa.concat_arrays([nulls[w], smallest(ids.take(pa.array(without)), k)]), k)

        def rows(q, ids, score, key):
            return pa.RecordBatch.from_arrays([queries.take(pa.array(q)), ids, score, key], ["query_id", "item_id", "score", "key"])

        def unscored(q: np.ndarray, n: np.ndarray, ids: pa.Array):
            """The first n of the ids for each of the queries."""
            n = np.minimum(n, len(ids))
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return rows(np.repeat(q, n), ids.take(pa.array(which)), pa.nulls(len(which), pa.float64()), pa.nulls(len(which), pa.float64()))

        for w in blocks:
            for block in blocks[w]:
                block.settle()
                yield rows(block.rows[block.q], block.ids, pa.array(block.score), pa.array(rounded(block.score)))
                if len(nulls[w]):
                    yield unscored(block.rows, k - np.bincount(block.q, minlength=len(block.rows)), nulls[w])
        for start in range(0, len(blank) if len(nulls.get(0, ())) else 0, HIGH):
            part = blank[start : start + HIGH]
            yield unscored(part, np.full(len(part), k), nulls[0])

    return run
