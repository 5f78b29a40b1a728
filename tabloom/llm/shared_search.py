"""Ranked lexical search of many items at once, with shared term sets evaluated once.

Items are dealt into blocks of bounded vocabulary.  For a block:

1. *Sharing graph.*  Terms that the same items hold form one leaf.  The leaves of every item,
   those of most items first, are a list; the pair of neighbours whose joint evaluation saves
   most document rows becomes a node in all lists that hold it, and so on until no pair is
   shared.  Nodes are term sets that several items share; an item is the sum of the few
   nodes and leaves left in its list.
2. *Postings.*  One scan of the documents finds the counts of the block's terms and the number
   of all terms of a text.  They are stored in the shared folder; document frequencies and
   totals are counted from them.
3. *Accumulators.*  A task turns a batch of documents into contributions per term, builds the
   partial document scores of every node once, in the order of the graph, and adds them up per
   item.  Scores are integers, so the order of additions changes nothing.  Each task keeps
   the best ``k`` of every item over all of its batches; they meet by item, in two rounds.

Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z lowered.

What moves: per task and item at most ``k`` rows.  Postings are written and read once per block.
A block's terms and graph are broadcast; both are bounded by ``BLOCK_TERMS`` (a single longer item is
a block of its own), and released before the next block.

Defined cases: a null or empty text, of an item or of a document, has no terms; an item without
terms, or whose terms no document holds, gets no rows.  Texts of one item id are one item.
Repeated documents count as often as they occur and are ranked row by row.  Equal scores go by
document id, a null id last.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import checkpoint_dir
from .words import chunks

#: Distinct (item, term) pairs of a block of items.
BLOCK_TERMS = 1 << 18
#: Documents per item in the result.
TOP = 50
#: Share of the length norm and scale of a term's part of the score (fixed values).
LENGTH_PERCENT, SCALE = 50, 1_000_000_000
#: Documents scored at once, and the bytes of partial scores that lower it where many are held.
SCORE_ROWS, SCORE_BYTES = 4096, 64 << 20
#: Text bytes cut into terms at once.
TEXT_BYTES = 4 << 20
#: Rows of one item that meet in a task before the last round.
SALTS = 64

_FOLD = np.full(256, 32, dtype=np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[65:91] = np.arange(97, 123)


# ---- terms

def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms, owning row) of a text array."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset:]
    raw = texts.buffers()[2]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    data = np.frombuffer(raw, dtype=np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, dtype=np.uint8)
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets - lo)), pa.py_buffer(_FOLD[data]))
    parts = pc.split_pattern(folded, " ")
    rows = np.repeat(np.arange(len(texts)), np.diff(np.asarray(parts.offsets)))
    terms = parts.flatten()
    real = pc.greater(pc.binary_length(terms), 0)
    return terms.filter(real), rows[np.asarray(real)]


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term), each once."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "x", TEXT_BYTES):
            terms, rows = terms_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), terms.cast(pa.string())], names=["item", "term"])

    return items.select(F.col(key).alias("item"), F.col(text).alias("x")).mapInArrow(run, f"item {kind}, term string").distinct()


# ---- sharing graph

class Graph:
    """Term sets that items share.

    ``leaves``: term numbers of every leaf.  ``pairs``: the two parts of every further node, parts
    before wholes; node ``len(leaves) + i`` is ``pairs[i]``.  ``items``: the parts of every item.
    """

    def __init__(self, terms: list[list[int]], rows: list[int]):
        """``terms`` per item, ``rows`` the expected number of documents per term."""
        holders: dict[int, list[int]] = defaultdict(list)
        for i, own in enumerate(terms):
            for t in own:
                holders[t].append(i)
        same: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for t, own in holders.items():
            same[tuple(own)].append(t)
        order = sorted(same, key=lambda own: (-len(own), own))
        self.leaves = [sorted(same[own]) for own in order]
        self.items: list[list[int]] = [[] for _ in terms]
        for leaf, own in enumerate(order):
            for i in own:
                self.items[i].append(leaf)
        self.pairs: list[tuple[int, int]] = []
        self._share([sum(rows[t] for t in own) for own in self.leaves])

    def _share(self, cost: list[int]) -> None:
        """Replace the neighbours that save most, again and again, while any two are shared."""
        count: Counter = Counter()
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, own in enumerate(self.items):
            for pair in zip(own, own[1:]):
                count[pair] += 1
                where[pair].add(i)
        gain = lambda pair: -(count[pair] - 1) * (cost[pair[0]] + cost[pair[1]] + 1)
        heap = [(gain(p), p) for p, n in count.items() if n > 1]
        heapify(heap)
        while heap:
            saved, pair = heappop(heap)
            if count[pair] < 2 or saved != gain(pair):
                if count[pair] > 1 and saved < gain(pair):
                    heappush(heap, (gain(pair), pair))
                continue
            node = len(self.leaves) + len(self.pairs)
            self.pairs.append(pair)
            cost.append(cost[pair[0]] + cost[pair[1]])
            touched = set()
            for i in where.pop(pair):
                old = self.items[i]
                new, at = [], 0
                while at < len(old):
                    if tuple(old[at: at + 2]) == pair:
                        new.append(node)
                        at += 2
                    else:
                        new.append(old[at])
                        at += 1
                if len(new) == len(old):
                    continue
                for p in zip(old, old[1:]):
                    count[p] -= 1
                for p in zip(new, new[1:]):
                    count[p] += 1
                    where[p].add(i)
                    touched.add(p)
                self.items[i] = new
            for p in touched:
                if count[p] > 1:
                    heappush(heap, (gain(p), p))

    def steps(self) -> list[tuple[int, ...]]:
        """What every step of an evaluation reads: the nodes in order, then the items."""
        return [*self.pairs, *map(tuple, self.items)]

    def last_use(self) -> dict[int, list[int]]:
        """Per step the nodes that no later step needs."""
        last = {node: step for step, own in enumerate(self.steps()) for node in own}
        done: dict[int, list[int]] = defaultdict(list)
        for node, step in last.items():
            done[step].append(node)
        return done

    def most_held(self) -> int:
        """The most partial scores that an evaluation holds at once."""
        done, held, most = self.last_use(), set(), 1
        for step, own in enumerate(self.steps()):
            held.update(own)
            if step < len(self.pairs):
                held.add(len(self.leaves) + step)
            most = max(most, len(held))
            held.difference_update(done.get(step, ()))
        return most

    def additions(self) -> int:
        """Node and leaf sums that an evaluation forms."""
        return len(self.pairs) + sum(len(own) for own in self.items)


# ---- documents

def _postings(docs: DataFrame, held: Broadcast, key: str, text: str) -> DataFrame:
    """(doc_id, n, terms, counts): number of all terms of a text, and its counts of the vocabulary's terms."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("x"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = pa.array(held.value, type=pa.large_string()), max(len(held.value), 1)
        for batch in chunks(batches, "x", TEXT_BYTES):
            terms, row = terms_of(batch.column(1))
            n = np.bincount(row, minlength=batch.num_rows)
            term = pc.index_in(terms, value_set=known)
            own = np.asarray(term.is_valid())
            cell, counts = np.unique(row[own] * size + np.asarray(term.filter(pa.array(own))).astype(np.int64), return_counts=True)
            row, term = cell // size, (cell % size).astype(np.int32)
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(term)), pa.ListArray.from_arrays(offsets, pa.array(counts))],
                names=["doc_id", "n", "terms", "counts"])

    return rows.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, counts array<long>")


class _Best:
    """The best ``k`` (score, document) of an item; a null document comes last among equals."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 0

    def offer(self, scores: np.ndarray, ids: pa.Array) -> None:
        fits = np.flatnonzero((scores >= self.least) & (scores > 0))
        if len(fits) > self.k:
            cut = np.partition(scores[fits], len(fits) - self.k)[len(fits) - self.k]
            fits = fits[scores[fits] >= cut]
        if not len(fits):
            return
        both = self.rows + list(zip(scores[fits].tolist(), ids.take(pa.array(fits)).to_pylist()))
        both.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
        self.rows = both[: self.k]
        if len(self.rows) == self.k:
            self.least = self.rows[-1][0]


def contributions(weights: np.ndarray, counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Integer part of the score that a term adds, by its weight and count and its document's length norm."""
    return weights * ((SCALE * counts) // (1000 * counts + 20 * norms))


def evaluate(graph: Graph, last: dict[int, list[int]], postings: dict[int, tuple[np.ndarray, np.ndarray]], rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """(item, scores of all rows) of items with a term in them; each node's partial scores are formed once and dropped after their last use."""
    partial: dict[int, np.ndarray | None] = {}

    def scores(node: int) -> np.ndarray | None:
        if node not in partial:
            acc = None
            for t in graph.leaves[node]:
                if t in postings:
                    at, part = postings[t]
                    if acc is None:
                        acc = np.zeros(rows, dtype=np.int64)
                    acc[at] += part
            partial[node] = acc
        return partial[node]

    for i, (a, b) in enumerate(graph.pairs):
        x, y = scores(a), scores(b)
        partial[len(graph.leaves) + i] = y if x is None else x if y is None else x + y
        for node in last.get(i, ()):
            del partial[node]
    for i, own in enumerate(graph.items):
        parts = [p for p in map(scores, own) if p is not None]
        if parts:
            total = parts[0].copy()
            for p in parts[1:]:
                total += p
            yield i, total
        for node in last.get(len(graph.pairs) + i, ()):
            del partial[node]


def _scored(postings: DataFrame, held: Broadcast, totals: tuple[int, int], k: int) -> DataFrame:
    """(item number, doc_id, score): the best ``k`` of every item and task; ``held`` is the graph, its last uses, weights and rows at once."""
    kind = postings.schema["doc_id"].dataType.simpleString()
    n_docs, n_terms = totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, weight, size = held.value
        best = [_Best(k) for _ in own.items]
        for batch in (b.slice(at, size) for b in batches for at in range(0, b.num_rows, size)):
            ids, n, terms, counts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n", "terms", "counts"))
            norms = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * np.asarray(n) * n_docs) // n_terms
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(terms)))
            term, tf = np.asarray(terms.flatten()), np.asarray(counts.flatten())
            if not len(term):
                continue
            order = np.argsort(term, kind="stable")
            term, row, part = term[order], row[order], contributions(weight[term], tf, norms[row])[order]
            at = np.flatnonzero(np.diff(term, prepend=-1))
            found = {int(t): (row[a:b], part[a:b]) for t, a, b in zip(term[at], at, [*at[1:], len(term)])}
            for i, scores in evaluate(own, last, found, batch.num_rows):
                best[i].offer(scores, ids)
        item = [i for i, b in enumerate(best) for _ in b.rows]
        if item:
            yield pa.RecordBatch.from_arrays([
                pa.array(item, type=pa.int32()), pa.array([d for b in best for _, d in b.rows], type=ids.type), pa.array([s for b in best for s, _ in b.rows], type=pa.int64())],
                names=["item", "doc_id", "score"])

    return postings.mapInArrow(run, f"item int, doc_id {kind}, score long")


def _top(rows: DataFrame, k: int, *by: Column | str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(terms: DataFrame, size: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Items with their terms, in blocks of about ``size`` terms; items are dealt by a hash of their id."""
    n = -(-terms.count() // size)
    dealt = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(n, 1))))
    for b in range(n):
        own = dealt.where(F.col("block") == b).groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms"))
        yield [(r.item, r.terms) for r in own.orderBy("item").collect()]


def search(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item.  Runs jobs, block by block."""
    spark = docs.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    terms = item_terms(items, item_key, item_text).checkpoint()
    kinds = f"item_id {items.schema[item_key].dataType.simpleString()}, rank int, doc_id {docs.schema[key].dataType.simpleString()}, score long"
    found = None
    for b, block in enumerate(_blocks(terms, block_terms)):
        part = _search_block(spark, docs, block, k, key, text, f"{base}/{b}", kinds)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], kinds) if found is None else found


def _search_block(spark: SparkSession, docs: DataFrame, block: list[tuple[object, list[str]]], k: int, key: str, text: str, base: str, kinds: str) -> DataFrame | None:
    """The block's result as a stored table; None when no document has a term."""
    vocabulary = sorted({t for _, own in block for t in own})
    held = spark.sparkContext.broadcast(vocabulary)
    _postings(docs, held, key, text).write.parquet(f"{base}/postings")
    held.destroy()
    postings = spark.read.parquet(f"{base}/postings")
    totals = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = {r.t: r.df for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
    if not totals[0] or not df:
        return None
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = [df.get(i, 0) for i in range(len(vocabulary))]
    graph = Graph([[number[t] for t in own] for _, own in block], rows)
    weights = [math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * n + 1))) for n in rows]
    size = min(SCORE_ROWS, max(64, SCORE_BYTES // (8 * graph.most_held())))
    held = spark.sparkContext.broadcast((graph, graph.last_use(), np.array(weights, dtype=np.int64), size))
    scored = _scored(postings, held, (totals[0], totals[1]), k)
    some = _top(scored.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), k, "item", "salt").drop("rank", "salt")
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, {kinds.split(',')[0]}")
    _top(some, k, "item").join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score").write.parquet(f"{base}/found")
    held.destroy()
    return spark.read.parquet(f"{base}/found")
