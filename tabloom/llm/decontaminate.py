"""Benchmark decontamination by winnowing.

Every text keeps the minimum hash of its k-word grams in each sliding window of ``w`` grams
(rightmost on ties).  Two texts that share ``k + w - 1`` words share such a fingerprint, so
joining the fingerprints of documents and benchmark items and extending each hit to the ten-word
windows around it finds every shared span of that length.  A window counts if an item has it,
by its words.  An item of fewer words is one window of its own length, matched through its
single gram of that length.

A benchmark of up to ``BLOCK_BYTES`` of text (counted first) is broadcast: the documents are read
once and never move.  A larger one is joined in Spark: the documents' fingerprints with the
items' distinct ones by hash, then the windows around the shared ones with the items' windows by
digest.  Nothing of it passes the driver; both joins are shuffled equi-joins, in which a hot
fingerprint or window adds one row per place and no pairs (AQE splits the partition of a hot one).
Equal texts go through these joins once.

Defined cases: null, empty or word-free texts have no words and no hits; a word-free item
matches nothing; each row of repeated documents gets its result; several rows of one item id
are one item in the results; an item without id marks words but is not listed.  Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_dir
from .words import U, Words, chunks, mix

#: Words of a window; words of a gram; grams of a winnowing window (K + W - 1 = SPAN).
SPAN, K, W = 10, 5, 6
#: Item text that is broadcast; more is joined.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 20
_SPANS = "array<struct<a:bigint,b:bigint>>"


def winnow(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indices of the grams that some window of W grams of one row selects."""
    n = len(hashes) - W + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, W):
        later = hashes[j: n + j]
        take = later <= best
        best[take] = later[take]
        at[take] = np.flatnonzero(take) + j
    chosen = np.zeros(len(hashes), dtype=bool)
    chosen[at[rows[:n] == rows[W - 1:]]] = True
    return np.flatnonzero(chosen)


def near_windows(docs: Words, known: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the windows of SPAN words around the fingerprints that are ``known``."""
    grams, first = docs.grams(K)
    pick = winnow(grams, docs.row[first])
    place = first[pick[known(grams[pick])]]
    near = np.zeros(len(docs.row) + 1, dtype=bool)
    for j in range(SPAN - K + 1):
        near[np.maximum(place - j, 0)] = True  # a window too many is compared in vain
    h, at = docs.grams(SPAN)
    return h[near[at]], at[near[at]]


def fingerprints(words: Words) -> np.ndarray:
    """Distinct fingerprints of the texts of SPAN words or more."""
    grams, at = words.grams(K)
    pick = winnow(grams, words.row[at])
    return np.unique(grams[pick[words.count[words.row[at[pick]]] >= SPAN]])


def item_windows(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hash, first word) of the windows of item texts, by length."""
    for m in range(1, SPAN + 1):
        own = np.flatnonzero(words.count == m if m < SPAN else words.count >= SPAN)
        if own.size:
            h, at = words.grams(m)
            mine = np.isin(words.row[at], own)
            yield m, h[mine], at[mine]


def _filter(hashes: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
    seen[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return seen


def _find(hashes: np.ndarray, seen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value among the sorted distinct ``hashes``, -1 without one."""
    out = np.full(len(wanted), -1, dtype=np.int64)
    maybe = np.flatnonzero(seen[(wanted >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    at = np.minimum(np.searchsorted(hashes, wanted[maybe]), max(len(hashes) - 1, 0))
    same = hashes[at] == wanted[maybe] if len(hashes) else np.zeros(len(maybe), dtype=bool)
    out[maybe[same]] = at[same]
    return out


class ItemIndex:
    """Fingerprints and windows of a benchmark that fits in memory."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.ids, self.words = np.array(ids, dtype=object), Words(pa.array(texts, type=pa.large_string()))
        self.prints = fingerprints(self.words)
        self.seen = _filter(self.prints)
        self.tables = {m: self._table(h, at) for m, h, at in item_windows(self.words)}

    def _table(self, h: np.ndarray, at: np.ndarray):
        """Distinct windows: hashes, their filter, one place of each, their class, and the items of each class.

        Windows that the same items have are one class, so a passage of many items costs their number once.
        """
        pairs = np.unique(np.rec.fromarrays([h, self.words.row[at]], names="h,row"))
        hashes, first = np.unique(h, return_index=True)
        group = np.searchsorted(hashes, pairs.h)
        owners = np.zeros(len(hashes), dtype=U)
        np.add.at(owners, group, mix(pairs.row.astype(U) + U(1)))
        _, one, of = np.unique(owners, return_index=True, return_inverse=True)
        bounds = np.searchsorted(group, np.arange(len(hashes) + 1))
        return hashes, _filter(hashes), at[first], of, [pairs.row[bounds[i]: bounds[i + 1]] for i in one]

    def hits(self, docs: Words) -> dict[int, tuple[set[str], list[dict[str, int]]]]:
        """By document row: item ids, and spans of hit words (row-relative, end exclusive)."""
        edge, ids = np.zeros(len(docs.row) + 1, dtype=np.int64), defaultdict(set)
        for m, (hashes, seen, place, of, owners) in self.tables.items():
            h, at = docs.grams(m) if m < SPAN else near_windows(docs, lambda x: _find(self.prints, self.seen, x) >= 0)
            window = _find(hashes, seen, h)
            keep = np.flatnonzero(window >= 0)
            keep = keep[[docs.text(int(at[k]), m) == self.words.text(int(place[window[k]]), m) for k in keep]] if keep.size else keep
            np.add.at(edge, at[keep], 1)
            np.add.at(edge, at[keep] + m, -1)
            for row, c in set(zip(docs.row[at[keep]].tolist(), of[window[keep]].tolist())):
                ids[row].update(self.ids[owners[c]].tolist())
        hit = np.cumsum(edge)[:-1] > 0
        new = hit & np.concatenate(([True], ~hit[:-1] | (docs.row[1:] != docs.row[:-1])))[: len(hit)]
        found: dict[int, tuple[set[str], list[dict[str, int]]]] = {}
        starts, places = np.flatnonzero(new), np.flatnonzero(hit)
        ends = places[np.append(np.searchsorted(places, starts)[1:], len(places)) - 1] + 1 if len(starts) else starts
        for a, b in zip(starts.tolist(), ends.tolist()):
            row = int(docs.row[a])
            base = int(docs.first[row])
            found.setdefault(row, (ids[row] - {None}, []))[1].append({"a": a - base, "b": b - base})
        return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (x, ...) with the number of words of each in place of n_words."""
    for batch in chunks(batches, "x"):
        yield batch.set_column(batch.schema.get_field_index("n_words"), "n_words", pa.array(Words(batch.column(0)).count.astype(np.int64)))


def _finder(index):
    """A task that adds words, spans and items to batches of (x, n_words, spans, items, ...)."""
    def find(batches):
        items = ItemIndex(*index.value)
        for batch in chunks(batches, "x"):
            col = {f.name: batch.column(n) for n, f in enumerate(batch.schema)}
            words = Words(col["x"])
            found = items.hits(words)
            empty: tuple[set[str], list] = (set(), [])
            col["n_words"] = pa.array(words.count.astype(np.int64))
            col["spans"] = pa.array([found.get(r, empty)[1] for r in range(words.rows)], type=col["spans"].type)
            col["items"] = pa.array([sorted(found.get(r, empty)[0]) for r in range(words.rows)], type=col["items"].type)
            yield pa.RecordBatch.from_arrays([col[f.name].cast(f.type) for f in batch.schema], schema=batch.schema)

    return find


def _digest(words: Words, at: np.ndarray, m: int) -> pa.Array:
    return pa.array([hashlib.blake2b(words.text(int(a), m), digest_size=16).digest() for a in at], type=pa.binary())


def _print_rows(lengths: set[int], items: bool):
    """(m, h, t) of the fingerprints (m = 0) and the short windows (m words) of the texts (t, x)."""
    def emit(batches):
        for batch in chunks(batches, "x"):
            words = Words(batch.column(1))
            if items:
                tables = [(m, h, at) for m, h, at in item_windows(words) if m < SPAN]
            else:
                tables = [(m, *words.grams(m)) for m in sorted(lengths)]
            grams, at = words.grams(K)
            pick = winnow(grams, words.row[at])
            pick = pick[words.count[words.row[at[pick]]] >= SPAN]
            for m, h, at in [(0, grams[pick], at[pick]), *tables]:
                both = np.unique(np.rec.fromarrays([words.row[at], h], names="row,h"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), m, dtype=np.int32)), pa.array(both.h.view(np.int64)),
                                                  batch.column(0).take(pa.array(both.row))], names=["m", "h", "t"])

    return emit


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, i): digest of each window of the items (i, x)."""
    for batch in chunks(batches, "x"):
        words = Words(batch.column(1))
        for m, _, at in item_windows(words):
            yield pa.RecordBatch.from_arrays([_digest(words, at, m), batch.column(0).take(pa.array(words.row[at]))], names=["w", "i"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, w, a, b): windows of the texts (t, x, prints) around their shared fingerprints, and their shared short windows."""
    for batch in batches:
        for n in range(batch.num_rows):
            words, shared = Words(batch.column(1).slice(n, 1)), defaultdict(list)
            for p in batch.column(2)[n].as_py():
                shared[p["m"]].append(p["h"])
            for m, hashes in shared.items():
                known = np.array(hashes, dtype=np.int64).view(U)
                h, at = near_windows(words, lambda x: np.isin(x, known)) if m == 0 else words.grams(m)
                at = at if m == 0 else at[np.isin(h, known)]
                size = m or SPAN
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[n].as_py()] * len(at), type=pa.string()), _digest(words, at, size),
                     pa.array(at.astype(np.int64)), pa.array((at + size).astype(np.int64))], names=["t", "w", "a", "b"])


def joined_hits(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(t, spans, items) of the texts (t, x) with hits, for items (i, x) of any number; t is a digest of x."""
    checkpoint_dir(texts.sparkSession)
    kind = "m int, h bigint, t string"
    prints = items.select(F.lit("").alias("t"), "x").mapInArrow(_print_rows(set(), True), kind).select("m", "h").distinct().checkpoint()
    lengths = {r["m"] for r in prints.select("m").distinct().collect()} - {0}  # at most SPAN numbers
    once = texts.where("x <> ''").dropDuplicates(["t"])
    shared = once.mapInArrow(_print_rows(lengths, False), kind).join(prints, ["m", "h"], "left_semi")
    own = shared.groupBy("t").agg(F.collect_set(F.struct("m", "h")).alias("prints"))  # of one text
    near = once.join(own, "t").select("t", "x", "prints").mapInArrow(_window_rows, "t string, w binary, a bigint, b bigint")
    windows = items.mapInArrow(_item_rows, "w binary, i string").distinct().checkpoint()
    hit = near.join(windows.select("w").distinct(), "w", "left_semi").checkpoint()
    spans = hit.groupBy("t").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("s"))
    state = lambda out, a, b: F.struct(out.alias("out"), a.alias("a"), b.alias("b"))
    last = lambda s: F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))
    merged = F.aggregate(
        F.slice("s", 2, F.size("s")), state(F.array().cast(_SPANS), F.col("s")[0]["a"], F.col("s")[0]["b"]),
        lambda s, x: F.when(x["a"] <= s["b"], state(s["out"], s["a"], F.greatest(s["b"], x["b"]))).otherwise(state(last(s), x["a"], x["b"])), last)
    names = hit.select("t", "w").distinct().join(windows.where("i is not null"), "w").groupBy("t").agg(F.array_sort(F.collect_set("i")).alias("items"))
    return spans.select("t", merged.alias("spans")).join(names, "t", "left")


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_id: str = "item_id",
         item_text: str = "text", carry: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, spans (first word, end), items; with ``carry`` its row as struct ``doc``.

    Counts the benchmark's bytes when called, and fetches it if it is within the bound.
    """
    none = {"n_words": F.lit(0).cast("bigint"), "spans": F.array().cast(_SPANS), "items": F.array().cast("array<string>")}
    rows = docs.select(F.col(text).alias("x"), F.col(key).alias("doc_id"), *[F.struct("*").alias("doc")] * carry)
    order = ["doc_id", *["doc"] * carry, *none]
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("x"))
    if (items.agg(F.sum(F.octet_length("x") + 16)).first()[0] or 0) <= BLOCK_BYTES:
        got = items.sort("i", "x").collect()
        index = docs.sparkSession.sparkContext.broadcast(([r["i"] for r in got], [r["x"] for r in got]))
        rows = rows.withColumns(none)
        return rows.mapInArrow(_finder(index), rows.schema).select(*order)
    rows = rows.withColumn("t", F.sha2(F.coalesce("x", F.lit("")), 256))
    found = joined_hits(rows.select("t", "x"), items)
    rows = rows.withColumn("n_words", none["n_words"])
    rows = rows.mapInArrow(_counted, rows.schema).drop("x").join(found, "t", "left")
    return rows.withColumns({c: F.coalesce(c, none[c]) for c in ("spans", "items")}).select(*order)


def clean(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents without any hit, with their own columns."""
    return scan(docs, benchmark, carry=True, **names).where(F.size("spans") == 0).select("doc.*")
