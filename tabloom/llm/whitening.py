"""Embedding whitening by blockwise QR and a bidiagonal solver.

An entry c counts as the integer ``x = floor(64 c) + 1000000``.  Mean and components are those
of the fit list, which holds each distinct x vector once.  Each task centres its rows with the
exact integer sums and reduces them, block by block, to a triangular factor R; the factors of
the tasks are reduced in two more rounds.  What is left is one square matrix of the number of
dimensions: Householder reflections make it bidiagonal, dqds sweeps give its singular values,
twisted factorisations the directions (see ``bidiagonal``).  The covariance itself is never
formed.  A last pass projects every row.

What moves: the distinct vectors once (combined before the shuffle, so that a vector which a
third of all rows repeats moves once per task), a triangle per task, sums per dimension.

Defined cases: a null vector, or one with null, non-finite or too large (``LARGEST``) entries,
or of another length than most (of equally frequent lengths the greater), is left out, as is
an empty one.  A component without variance (singular value below ``NO_VARIANCE`` of the
greatest) is left out, so one distinct vector, or none, gives no rows.  A deviation that does
not fit a long is null.  Null keys and repeated rows get their own result rows.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_dir
from .bidiagonal import principal

#: Steps of an entry's unit, and what is added to make it positive (fixed values).
STEPS, OFFSET = 64, 1_000_000
#: Components returned.
COMPONENTS = 16
#: Entries beyond this have no exact step.
LARGEST = float(1 << 46)
#: Rows reduced at once.
BLOCK_ROWS = 4096
#: Singular value, as a share of the greatest, below which a direction has no variance.
NO_VARIANCE = 1e-12


def stepped(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x) of the usable rows; x as offsets from ``OFFSET``."""
    c = F.col(vec).cast("array<double>")
    unfit = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > LARGEST))
    return vectors.where(F.col(vec).isNotNull()).where((F.size(c) > 0) & ~unfit).select(
        F.col(key).alias("vec_id"), F.transform(c, lambda v: F.floor(v * STEPS).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit integers, or Python's where those could overflow."""
    s = np.array(sums, dtype=object)
    most = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums))
    return n * x - s.astype(np.int64) if most < 1 << 62 else n * x.astype(object) - s


def _squares(spread: np.ndarray) -> pa.Array:
    """Sum of squares of every row, exact; null beyond a long."""
    most = int(max(spread.max(initial=0), -spread.min(initial=0)))
    if most * most * spread.shape[1] < 1 << 63:
        return pa.array((spread.astype(np.int64) ** 2).sum(axis=1))
    total = (spread.astype(object) ** 2).sum(axis=1)
    return pa.array([v if v < 1 << 63 else None for v in total], type=pa.int64())


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """Vectors of a task in blocks of at least ``BLOCK_ROWS`` rows (the last may be smaller)."""
    held, rows = [], 0
    for batch in batches:
        held.append(_matrix(batch.column(batch.schema.get_field_index("x")), d))
        rows += len(held[-1])
        if rows >= BLOCK_ROWS:
            yield np.concatenate(held)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def _per_task(fit: DataFrame, d: int, reduce: Callable[[Iterator[np.ndarray]], np.ndarray]) -> DataFrame:
    """(part, v): one array per task that has vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(batches, d)
        first = next(blocks, None)
        if first is not None:
            v = reduce(b for bs in ([first], blocks) for b in bs)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], type=pa.int32()), pa.array([v.tolist()], type=pa.list_(pa.float64()))], names=["part", "v"])

    return fit.mapInArrow(run, "part int, v array<double>")


def _combined(parts: DataFrame, reduce: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """All tasks' arrays as one: about the square root of their number meet in a group, then the groups."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [0], "v": [reduce([np.asarray(v, dtype=float) for v in rows["v"]]).tolist()]})

    parts = parts.checkpoint()
    groups = isqrt(parts.count()) + 1
    some = parts.groupBy(F.pmod("part", F.lit(groups)).alias("g")).applyInPandas(run, "part int, v array<double>")
    return np.asarray(some.groupBy("part").applyInPandas(run, "part int, v array<double>").first().v)


class Whitening:
    """Mean and principal directions of the distinct vectors of a table; fitting runs jobs."""

    def __init__(self, rows: DataFrame, count: int = COMPONENTS):
        """``rows`` as :func:`stepped` returns them."""
        checkpoint_dir(rows.sparkSession)
        lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        self.d = d = lengths.d if lengths else 0
        self.n, self.values, self.identity_error = 0, np.zeros(0), 0.0
        if not d:
            return
        fit = rows.where(F.size("x") == d).select("x").distinct().checkpoint()
        self.n, self.sums = self._totals(fit)
        r = _combined(_per_task(fit, d, self._triangle), lambda found: self._reduced([v.reshape(-1, d) for v in found]).ravel()).reshape(-1, d)
        self.trace = float((r ** 2).sum()) / self.n
        squares, directions = principal(np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r, min(count, d))
        real = squares > max(squares[0], 0.0) * NO_VARIANCE ** 2
        self.values, self.directions = squares[real] / self.n, directions[:, real]
        if len(self.values):
            self.identity_error = self._check(fit)

    def _totals(self, fit: DataFrame) -> tuple[int, list[int]]:
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(d, dtype=object)
            for x in _blocks(batches, d):
                n += len(x)
                total += x.sum(axis=0) if int(np.abs(x).max()) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]])], names=["n", "s"])

        parts = fit.mapInArrow(run, "n long, s array<string>").checkpoint()
        sums = parts.select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        return parts.agg(F.sum("n")).first()[0], [int(r.s) for r in sums.orderBy("i").collect()]

    def _centred(self, x: np.ndarray) -> np.ndarray:
        return (_spread(x, self.n, self.sums) / self.n).astype(float)

    @staticmethod
    def _reduced(blocks: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.vstack(blocks), mode="r")

    def _triangle(self, blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, self.d))
        for x in blocks:
            r = self._reduced([r, self._centred(x)])
        return r.ravel()

    def project(self, x: np.ndarray) -> np.ndarray:
        return self._centred(x) @ (self.directions / np.sqrt(self.values))

    def _check(self, fit: DataFrame) -> float:
        """Largest entry of the whitened covariance minus the identity, over the fit list."""
        k = len(self.values)

        def scatter(blocks: Iterator[np.ndarray]) -> np.ndarray:
            return joined([moments(self.project(x)) for x in blocks])

        def moments(y: np.ndarray) -> np.ndarray:
            mean = y.mean(axis=0)
            return np.concatenate(([len(y)], mean, ((y - mean).T @ (y - mean)).ravel()))

        def joined(found: list[np.ndarray]) -> np.ndarray:
            out = found[0]
            for v in found[1:]:
                n = out[0] + v[0]
                gap = v[1: k + 1] - out[1: k + 1]
                out = np.concatenate(([n], out[1: k + 1] + gap * (v[0] / n), out[k + 1:] + v[k + 1:] + (np.outer(gap, gap) * (out[0] * v[0] / n)).ravel()))
            return out

        total = _combined(_per_task(fit, self.d, scatter), joined)
        return float(np.abs(total[k + 1:].reshape(k, k) / total[0] - np.eye(k)).max())

    def apply(self, rows: DataFrame) -> DataFrame:
        """vec_id, component, n, deviation, whitened, explained, identity_error of every row of the fitted length."""
        schema = (f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, "
                  "whitened double, explained double, identity_error double")
        k, d = len(self.values), self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), d)
                spread = _spread(x, self.n, self.sums)
                whitened = (spread / self.n).astype(float) @ (self.directions / np.sqrt(self.values))
                at = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), self.n)),
                    _squares(spread).take(at), pa.array(whitened.ravel()), pa.array(np.tile(self.values / self.trace, len(x))),
                    pa.array(np.full(len(at), self.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        if not k:
            return rows.sparkSession.createDataFrame([], schema)
        return rows.where(F.size("x") == d).mapInArrow(run, schema)


def whiten(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id", count: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component; the directions are fitted on the distinct vectors."""
    rows = stepped(vectors, vec, key)
    return Whitening(rows, count).apply(rows)
