"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts become sets of five-word shingles.  Equal sets collapse into one class with a copy
count, so copies are never paired.  Each class gets ``BANDS * ROWS`` MinHash values; classes
that agree on all values of a band meet in that band's bucket.  Pairs of a bucket compare
their values ``STEP`` at a time: with ``m`` of ``n`` equal and a uniform prior the similarity
is Beta(m + 1, n - m + 1), and a pair is dropped once its probability of reaching the
threshold falls below ``TOLERANCE``.  The rest are verified exactly on their shingles.

Scale: buckets whose member sets equal that of a kept bucket are dropped, and a pair counts
only in the first kept bucket it shares.  A bucket of more than ``BLOCK`` classes is dealt
as pairs of blocks to different tasks.  Tasks emit one row per member (link count and local
root), never pairs.  Local roots become components by alternating large and small stars,
with a reliable checkpoint after each round.

Defined cases: a text of one to four words is one shingle; a null, empty or word-free text
has no shingle, no links and is its own class.  Repeated rows are copies of each other.
Extra columns are ignored.  The band step misses a pair at the threshold with probability
(1 - 0.8**5)**32 = 3e-6; pairs above it are missed less often.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .words import U, Words, chunks, mix

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-8
BANDS, ROWS, STEP = 32, 5, 32
HASHES = BANDS * ROWS
#: Classes of one bucket that meet in one task as one block; pairs and texts handled at once.
BLOCK, PAIRS, GATHER_BYTES = 1024, 1 << 17, 8 << 20

_seeds = np.random.default_rng(20240229).integers(0, 1 << 32, size=(2, HASHES), dtype=np.uint32) | np.uint32(1)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values among ``n`` that keep P(similarity >= threshold) at or above the tolerance."""
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds): sorted distinct shingle hashes, those of row i at bounds[i]:bounds[i + 1]."""
    words = Words(texts)
    h, rows = words.shingles(SHINGLE)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[new], rows[new]
    return h, np.searchsorted(rows, np.arange(words.rows + 1))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Low 16 bits of the MinHash values (rows x HASHES); rows without shingles get zeros.

    Unlike values agree in 16 bits once in 65,536 times, which only keeps a pair longer.
    """
    out = np.zeros((len(bounds) - 1, HASHES), dtype=np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if full.size:
        low, high, at = h.astype(np.uint32), (h >> U(32)).astype(np.uint32), bounds[:-1][full]
        for j in range(HASHES):
            out[full, j] = np.minimum.reduceat(low * _seeds[0, j] + high * _seeds[1, j], at) & np.uint32(0xFFFF)
    return out


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row key once per task, so that a row repeated any number of times moves its text once per task."""
    seen: set[int] = set()
    for batch in batches:
        new = [k not in seen and not seen.add(k) for k in batch.column(0).to_pylist()]
        yield batch if all(new) else batch.filter(pa.array(new, type=pa.bool_()))


def _digests(h: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    return [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "x"):
        h, bounds = shingle_sets(batch.column(2))
        sig = signatures(h, bounds)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(_digests(h, bounds), type=pa.binary()), pa.array([s.tobytes() for s in sig], type=pa.binary())],
            names=["doc_id", "row_key", "id", "sig"])


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, BANDS, ROWS)
        key = np.zeros(sig.shape[:2], dtype=U)
        for j in range(ROWS):
            key = mix(key + sig[:, :, j])
        n = len(sig)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(np.repeat(np.arange(n), BANDS))),
             pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(key.reshape(-1).view(np.int64))],
            names=["id", "band", "bucket"])


def _pairs(start: np.ndarray, block: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs to compare, group by group, in lots of about PAIRS."""
    lot_a, lot_b, size = [], [], 0
    for s, e in zip(start[:-1], start[1:]):
        if lo[s] == hi[s]:
            for i in range(s, e - 1):
                lot_a.append(np.full(e - i - 1, i))
                lot_b.append(np.arange(i + 1, e))
                size += e - i - 1
                if size >= PAIRS:
                    yield np.concatenate(lot_a), np.concatenate(lot_b)
                    lot_a, lot_b, size = [], [], 0
        else:
            own = np.arange(s, e)
            left, right = own[block[s:e] == lo[s]], own[block[s:e] == hi[s]]
            for i in left:
                lot_a.append(np.full(len(right), i))
                lot_b.append(right)
                size += len(right)
                if size >= PAIRS:
                    yield np.concatenate(lot_a), np.concatenate(lot_b)
                    lot_a, lot_b, size = [], [], 0
    if size:
        yield np.concatenate(lot_a), np.concatenate(lot_b)


def _link(table: pa.Table) -> pa.RecordBatch:
    """Links among the members of whole groups: (id, links, root) of members that have any."""
    ids = table["id"].to_pylist()
    col = {c: np.asarray(table[c]) for c in ("band", "bucket", "block", "lo", "hi", "mask", "copies")}
    n = len(ids)
    edge = np.zeros(n + 1, dtype=bool)
    edge[[0, n]] = True
    for c in ("band", "bucket", "lo", "hi"):
        edge[1:n] |= col[c][1:] != col[c][:-1]
    start = np.flatnonzero(edge)
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint16).reshape(n, HASHES)
    h, bounds = shingle_sets(table["x"].combine_chunks() if isinstance(table["x"], pa.ChunkedArray) else table["x"])
    group = np.cumsum(edge[:n])
    seen: set[tuple[int, bytes]] = set()
    valid = np.zeros(n, dtype=bool)  # a row key may be shared by another text, and a row repeated
    for i, d in enumerate(_digests(h, bounds)):
        if d == ids[i] and (int(group[i]), d) not in seen:
            seen.add((int(group[i]), d))
            valid[i] = True
    size = np.diff(bounds)
    vocabulary, word = np.unique(h, return_inverse=True)
    flag = np.zeros(len(vocabulary), dtype=bool)
    found_a, found_b = [], []
    for a, b in _pairs(start, col["block"], col["lo"], col["hi"]):
        ok = valid[a] & valid[b]
        a, b = a[ok], b[ok]
        equal = np.zeros(len(a), dtype=np.int32)
        for at in range(0, HASHES, STEP):
            equal += (sig[a, at: at + STEP] == sig[b, at: at + STEP]).sum(1, dtype=np.int32)
            ok = equal >= least_matches(at + STEP)
            a, b, equal = a[ok], b[ok], equal[ok]
        for t in range(BANDS - 1):
            both = (t < col["band"][a]) & ((col["mask"][a] >> t) & 1).astype(bool)
            if both.any():
                ok = ~(both & (sig[a, t * ROWS: (t + 1) * ROWS] == sig[b, t * ROWS: (t + 1) * ROWS]).all(1))
                a, b = a[ok], b[ok]
        cut = np.flatnonzero(np.diff(a, prepend=-1)) if len(a) else np.zeros(0, dtype=np.int64)
        for s, e in zip(cut, np.append(cut[1:], len(a))):
            i, others = a[s], b[s:e]
            own = word[bounds[i]: bounds[i + 1]]
            flag[own] = True
            lens = size[others]
            at = np.repeat(bounds[others] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
            shared = np.add.reduceat(flag[word[at]].astype(np.int64), np.concatenate(([0], np.cumsum(lens)[:-1])))
            flag[own] = False
            near = others[shared >= THRESHOLD * (size[i] + lens - shared) - 1e-9]
            found_a.append(np.full(len(near), i))
            found_b.append(near)
    a = np.concatenate(found_a) if found_a else np.zeros(0, dtype=np.int64)
    b = np.concatenate(found_b) if found_b else np.zeros(0, dtype=np.int64)
    links = np.bincount(a, col["copies"][b], n) + np.bincount(b, col["copies"][a], n)
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        if (low == root[a]).all() and (low == root[b]).all():
            break
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
    out = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [pa.array([ids[i] for i in out], type=pa.binary()), pa.array(links[out].astype(np.int64)), pa.array([ids[i] for i in root[out]], type=pa.binary())],
        names=["id", "links", "root"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gather whole groups (rows come sorted by group) until they hold GATHER_BYTES, then link them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHER_BYTES:
            table = pa.Table.from_batches(held)
            last = [table[c][-1].as_py() for c in ("band", "bucket", "lo", "hi")]
            same = np.ones(table.num_rows, dtype=bool)
            for c, v in zip(("band", "bucket", "lo", "hi"), last):
                same &= np.asarray(table[c]) == v
            keep = int(np.flatnonzero(~same).max(initial=-1)) + 1  # the last group may go on
            if keep:
                yield _link(table.slice(0, keep))
            held, size = table.slice(keep).to_batches(), table.slice(keep).nbytes if keep else 0
    if held and sum(x.num_rows for x in held):
        yield _link(pa.Table.from_batches(held))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of (id, root) edges: alternating large and small stars."""
    edges = edges.where("id <> root").distinct().checkpoint()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("id"), F.col("id").alias("root")))
        low = both.groupBy("id").agg(F.least(F.min("root"), F.col("id")).alias("low"))
        large = both.join(low, "id").where("root > id").select(F.col("root").alias("id"), F.col("low").alias("root"))
        down = large.where("id > root").distinct()
        low = down.groupBy("id").agg(F.min("root").alias("low"))
        small = down.join(low, "id").select(F.explode(F.array(
            F.struct(F.col("root").alias("id"), F.col("low").alias("root")), F.struct("id", F.col("low").alias("root")))).alias("e")).select("e.*")
        edges = small.where("id <> root").distinct().checkpoint()
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "root").cast("decimal(38,0)"))).first())
        if now == state:
            return edges
        state = now


def link(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, class_key, class_id, n_links.

    ``class_key`` names the class; ``class_id`` is the least id of the documents joined by chains of links; ``n_links`` is
    the number of other rows whose similarity reaches the threshold.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("row_key"), F.col(text).alias("x"))
    signed = rows.mapInArrow(_sign, "doc_id " + rows.schema["doc_id"].dataType.simpleString() + ", row_key bigint, id binary, sig binary").checkpoint()
    classes = signed.where("id is not null").groupBy("id").agg(
        F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")).checkpoint()
    bands = classes.select("id", "sig").mapInArrow(_band, "id binary, band int, bucket bigint")
    shared = bands.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("members")).where("n > 1")
    kept = shared.groupBy("n", "members").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.band", "b.bucket", "n")
    members = bands.join(kept, ["band", "bucket"]).checkpoint()
    masks = members.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask"))
    texts = rows.select("row_key", "x").mapInArrow(_once, "row_key bigint, x string").join(classes.join(masks, "id").select("id", "row_key", "copies", "sig", "mask"), "row_key").drop("row_key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("id", "bucket"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "id", "band", "bucket", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    order = ["band", "bucket", "lo", "hi"]
    found = dealt.join(texts, "id").repartition(*order).sortWithinPartitions(*order).mapInArrow(
        _groups, "id binary, links bigint, root binary").checkpoint()
    roots = components(found.select("id", "root"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = classes.select("id", "least", "copies").join(links, "id", "left").join(roots, "id", "left").withColumn(
        "root", F.coalesce("root", "id"))
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("class_id")), "root").select(
        "id", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    return signed.select("doc_id", "row_key", "id").join(named.withColumnRenamed("root", "class_key"), "id", "left").select(
        "doc_id", "row_key", F.coalesce("class_key", F.encode(F.col("row_key").cast("string"), "UTF-8")).alias("class_key"),
        F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"))


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class, one with the least id, with its own columns."""
    keep = link(docs, text, key).groupBy("class_key").agg(F.min(F.struct("doc_id", "row_key")).alias("r")).select(
        F.col("r.row_key").alias("k")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col(key), F.col(text)).alias("k"))
    first = Window.partitionBy("k").orderBy("k")
    return rows.join(keep, "k", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("doc.*")
