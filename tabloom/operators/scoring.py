"""Scoring of one cell of documents against one block of queries, inside a task.

Both functions return a function for ``cogroup().applyInArrow``: it takes the
documents and the queries of a (query block, cell) and gives the best ``k``
rows of every (query, group), ordered by rounded score and then by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Documents whose greatest weights bound a block, and scores a task holds at once.
BLOCK_DOCS = 128
SCORE_CELLS = 1 << 20


def _codes(table: pa.Table, cols) -> np.ndarray:
    """Number of the run of equal values that each row of a sorted table is in."""
    new = np.zeros(table.num_rows, dtype=bool)
    for c in cols:
        ids = np.asarray(pc.fill_null(table[c].combine_chunks().dictionary_encode().indices, -1))
        new[1:] |= ids[1:] != ids[:-1]
    return np.cumsum(new)


def _sorted(table: pa.Table, cols) -> pa.Table:
    """Rows in the order of the columns, nulls first, as Spark orders them."""
    if not cols:
        return table
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in cols], null_placement="at_start"))


def _runs(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(np.diff(codes, prepend=-1))
    yield from zip(at.tolist(), [*at[1:].tolist(), len(codes)])


class Best:
    """The best ``k`` documents of one query and group; documents are numbered in key order."""

    __slots__ = ("k", "rounded", "docs", "scores")

    def __init__(self, k: int):
        self.k = k
        self.rounded = self.scores = np.zeros(0)
        self.docs = np.zeros(0, dtype=np.int64)

    def least(self) -> float:
        """A later document with a lower rounded score cannot enter; minus infinity while the list is short."""
        return self.rounded[-1] if len(self.docs) == self.k else -np.inf

    def offer(self, rounded: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        if len(self.docs) == self.k:
            # documents come in key order, so one that only ties with the last stays out
            fits = rounded > self.rounded[-1]
            rounded, docs, scores = rounded[fits], docs[fits], scores[fits]
        if not len(docs):
            return
        rounded, docs, scores = (np.concatenate(x) for x in ((self.rounded, rounded), (self.docs, docs), (self.scores, scores)))
        order = np.lexsort((docs, -rounded))[: self.k]
        self.rounded, self.docs, self.scores = rounded[order], docs[order], scores[order]


def _result(found: list[tuple[int, Best]], ids: pa.Array, keys: pa.Table, name: str) -> pa.Table:
    """Rows of the best documents: query id, group and key columns, score."""
    query = np.concatenate([np.full(len(b.docs), q) for q, b in found]) if found else np.zeros(0, dtype=np.int64)
    docs = np.concatenate([b.docs for _, b in found]) if found else np.zeros(0, dtype=np.int64)
    score = np.concatenate([b.scores for _, b in found]) if found else np.zeros(0)
    rows = keys.take(pa.array(docs, type=pa.int64()))
    return pa.table([ids.take(pa.array(query, type=pa.int64())), *rows.columns, pa.array(score)], names=["query_id", *rows.column_names, name])


def sparse_cell(group_cols, key_cols, k: int, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Exact top-k by summed term weights, with bounds per block of documents.

    A block of documents knows the greatest weight of each of its terms.  A
    query whose bounds sum to less than its k-th score skips the block.  Else
    the weights of its terms, laid out as rows over the documents, are added
    up at once, and only documents above the k-th score are offered.
    """
    g, kk = list(group_cols), list(key_cols)
    slack = 10.0 ** -digits  # rounding may lift a score by half of it

    def score(docs: pa.Table, queries: pa.Table) -> pa.Table:
        docs = _sorted(docs.select([*g, *kk, "term", "w"]), [*g, *kk])
        terms = queries["term"].combine_chunks().unique().drop_null()
        ids = queries["query_id"].combine_chunks().unique()
        query = np.asarray(pc.index_in(queries["query_id"].combine_chunks(), value_set=ids))
        word = np.asarray(pc.fill_null(pc.index_in(queries["term"].combine_chunks(), value_set=terms, skip_nulls=True), -1))
        qtf = np.asarray(pc.fill_null(queries["qtf"].combine_chunks(), 0.0))
        wanted = [(word[query == q], qtf[query == q]) for q in range(len(ids))]
        wanted = [(t[t >= 0], f[t >= 0]) for t, f in wanted]
        asks = np.repeat(np.arange(len(wanted)), [len(t) for t, _ in wanted])
        every = [np.concatenate(x) if x else np.zeros(0) for x in zip(*wanted)] if wanted else [np.zeros(0, dtype=np.int64), np.zeros(0)]
        term = np.asarray(pc.fill_null(pc.index_in(docs["term"].combine_chunks(), value_set=terms, skip_nulls=True), -1)).astype(np.int64)
        weight = np.asarray(pc.fill_null(docs["w"].combine_chunks(), 0.0))
        doc = _codes(docs, [*g, *kk])
        first = np.flatnonzero(np.diff(doc, prepend=-1))  # a row of each document
        group = _codes(docs, g)
        found = []
        for a, b in _runs(group):
            best = [Best(k) for _ in wanted]
            for lo in range(int(doc[a]), int(doc[b - 1]) + 1, BLOCK_DOCS):
                hi = min(lo + BLOCK_DOCS, int(doc[b - 1]) + 1)
                s, e = np.searchsorted(doc, [lo, hi])
                _score_block(term[s:e], weight[s:e], doc[s:e] - lo, lo, hi - lo, wanted, best, len(terms), asks, *every)
            found += [(q, x) for q, x in enumerate(best)]
        return _result(found, ids, docs.select([*g, *kk]).take(pa.array(first)), "raw")

    def _score_block(term, weight, doc, lo, n, wanted, best, n_terms, asks, words, qtf) -> None:
        own = term >= 0
        term, weight, doc = term[own], weight[own], doc[own]
        bound = np.zeros(n_terms)
        np.maximum.at(bound, term, weight)
        reach = np.bincount(asks, qtf * bound[words], len(wanted))
        least = np.array([top.least() for top in best])
        left = np.flatnonzero((least < 0) | (reach >= least - slack))
        if not len(left):
            return
        here = np.unique(term)
        place = np.full(n_terms, -1)
        place[here] = np.arange(len(here))
        step = max(1, SCORE_CELLS // max(1, len(here)))
        for a in range(0, n, step):
            b = min(a + step, n)
            within = (doc >= a) & (doc < b)
            rows = np.zeros((len(here), b - a))
            rows[place[term[within]], doc[within] - a] = weight[within]
            for q in left:
                (t, f), top = wanted[q], best[q]
                at = place[t]
                sums = f[at >= 0] @ rows[at[at >= 0]]
                rounded = np.round(sums, digits)
                docs = np.flatnonzero(rounded > top.least())
                if len(docs):
                    top.offer(rounded[docs], docs + (lo + a), sums[docs])

    return score


def dense_cell(group_cols, key_cols, k: int, digits: int, similarity: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Exact top-k by cosine; vectors without direction are left out."""
    g, kk = list(group_cols), list(key_cols)

    def unit(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(rows that have a direction, their unit vectors)."""
        m = np.array(vectors.to_pylist(), dtype=np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
        norm = np.linalg.norm(m, axis=1) if m.size else np.zeros(len(m))
        keep = np.flatnonzero(norm > 0)
        return keep, m[keep] / norm[keep][:, None]

    def score(docs: pa.Table, queries: pa.Table) -> pa.Table:
        docs = _sorted(docs.select([*g, *kk, "v"]), [*g, *kk])
        keep, d = unit(docs["v"])
        asked, m = unit(queries["v"])
        keys = docs.select([*g, *kk])
        group = _codes(docs, g)[keep]
        found = []
        for a, b in _runs(group) if len(asked) and len(keep) else ():
            best = [Best(k) for _ in asked]
            step = max(1, SCORE_CELLS // len(asked))
            for lo in range(a, b, step):
                hi = min(lo + step, b)
                value = np.clip(m @ d[lo:hi].T, -1.0, 1.0)
                value = value if similarity else 1.0 - value
                rounded = np.round(value, digits) * (1.0 if similarity else -1.0)
                for top, r, v in zip(best, rounded, value):
                    near = np.flatnonzero(r >= np.partition(r, len(r) - k)[len(r) - k]) if len(r) > k else np.arange(len(r))
                    top.offer(r[near], keep[lo:hi][near], v[near])
            found += [(int(q), x) for q, x in zip(asked, best)]
        return _result(found, queries["query_id"].combine_chunks(), keys, "score")

    return score
