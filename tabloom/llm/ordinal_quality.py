"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the labels: 0 for poor quality, 1 for good but toxic, 2 for good and clean.
A text's features are its distinct words and the distinct gaps between them (punctuation and
blanks), hashed to ``CELLS``.  Cells that at least ``LEAST`` sampled texts hold carry weights,
regularised by how far the grades of their texts lie off the sample's: with the deviance G^2
of these grades, a cell counts 1 / (1 + (``SHRINK`` / G^2)^``POWER``).  So long texts do not sum
noise, and a rare word that one grade alone holds counts as much as a common one.  One weight vector is shared by all grades, with ordered thresholds: P(grade <= k) = sigmoid(theta_k - w.x).  The model gives
each document its expected grade and the tail probability P(grade >= 2), which selects.

The fit uses at most ``SAMPLE`` labelled keys, those with the least hash, as far as their hashed
features fit in ``SAMPLE_BYTES`` (the bounds are these parameters; four bytes a feature); these
features go to the driver, which runs adaptive gradient steps in a fixed order.  Scoring is one narrow pass over all whole texts with the
weights (CELLS numbers) as a broadcast.

Defined cases: null, empty and word-free texts have no features, so the thresholds alone
grade them; a key with several grades trains with each, and with one of its texts if several
rows have the key (that of the least features in byte order); without labels every grade is equally
likely and no document reaches the probability that selects.
Each row gets its result, whatever repeats; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .words import U, Words, chunks, mix, range_sums

CELLS, GRADES = 1 << 18, 3
SAMPLE, STEPS, RATE, RIDGE = 8_000, 80_000, 0.1, 1e-6
SAMPLE_BYTES = 256 << 20
LEAST, SHRINK, POWER = 3, 25.0, 4
SELECT = 0.5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cells, bounds): the distinct hash cells of row i at bounds[i]:bounds[i + 1]."""
    w = Words(texts)
    same = np.flatnonzero(w.row[1:] == w.row[:-1])
    gap = mix(range_sums(w.data, w.end[same], w.start[same + 1]) + U(0x5851F42D4C957F2D))
    rows = np.concatenate((w.row, w.row[same]))
    cells = np.concatenate((w.hash, gap)) >> U(64 - CELLS.bit_length() + 1)
    both = np.unique(rows.astype(np.int64) * CELLS + cells.astype(np.int64))
    return (both % CELLS).astype(np.int32), np.searchsorted(both // CELLS, np.arange(w.rows + 1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class CumulativeLink:
    """Weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray | None = None, thresholds: np.ndarray | None = None):
        self.weights = np.zeros(CELLS, dtype=np.float32) if weights is None else weights
        # equal shares of the grades
        self.thresholds = np.log(np.arange(1, GRADES) / np.arange(GRADES - 1, 0, -1)) if thresholds is None else thresholds

    def fit(self, rows: list[np.ndarray], grades: np.ndarray) -> "CumulativeLink":
        if not len(rows):
            return self
        w, square = np.zeros(CELLS), np.full(CELLS, 1e-8)
        share = np.cumsum(np.bincount(grades, minlength=GRADES) + 1.0)[:-1] / (len(grades) + GRADES)
        theta, theta_square = np.log(share / (1 - share)), np.full(GRADES - 1, 1e-8)
        scale = self._scale(rows, grades)
        rows = [r[scale[r] > 0] for r in rows]
        order = np.random.default_rng(7)
        for _ in range(-(-STEPS // len(rows))):
            for i in order.permutation(len(rows)):
                cells, k = rows[i], grades[i]
                x = scale[cells]
                upper = _sigmoid(theta - w[cells] @ x)
                above, below = (upper[k] if k < GRADES - 1 else 1.0), (upper[k - 1] if k else 0.0)
                slope_a, slope_b = above * (1 - above), below * (1 - below)
                p = max(above - below, 1e-9)
                grad = (slope_a - slope_b) / p * x + RIDGE * w[cells]  # of -log P(grade = k)
                square[cells] += grad * grad
                w[cells] -= RATE * grad / np.sqrt(square[cells])
                g = np.zeros(GRADES - 1)
                if k < GRADES - 1:
                    g[k] -= slope_a / p
                if k:
                    g[k - 1] += slope_b / p
                theta_square += g * g
                theta = np.maximum.accumulate(theta - 0.1 * RATE * g / np.sqrt(theta_square) + np.arange(GRADES - 1) * 1e-6)
        self.weights, self.thresholds = (w * scale).astype(np.float32), theta
        return self

    @staticmethod
    def _scale(rows: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
        """What a cell counts, 0 to 1; 0 below LEAST texts alone (or where every grade has just its share)."""
        cells, own = np.concatenate(rows), np.repeat(grades, [len(r) for r in rows])
        df, deviance = np.bincount(cells, minlength=CELLS), np.zeros(CELLS)
        for k, share in enumerate(np.bincount(grades, minlength=GRADES) / len(grades)):
            n = np.bincount(cells[own == k], minlength=CELLS)
            deviance += 2 * n * np.log(np.maximum(n, 1) / np.maximum(df * share, 1e-9))
        return np.where(df >= LEAST, 1 / (1 + (SHRINK / np.maximum(deviance, 1e-9)) ** POWER), 0.0)

    def score(self, cells: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, P(grade is the highest)) of each row."""
        sums = np.concatenate(([0.0], np.cumsum(self.weights[cells], dtype=np.float64)))
        z = sums[bounds[1:]] - sums[bounds[:-1]]
        over = 1 - _sigmoid(self.thresholds[None, :] - z[:, None])  # P(grade > k)
        return over.sum(1), over[:, -1]


def grades(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, grade) from quality and toxic marks; unmarked rows are left out."""
    return labels.where("quality is not null").select(key, F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))


def fit(docs: DataFrame, graded: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> CumulativeLink:
    """The model of a bounded, hash-ordered sample of the graded documents."""
    picked = graded.select(F.col(key).alias("k"), "grade").where(F.col("k").isNotNull()).distinct().orderBy(F.xxhash64("k"), "k", "grade").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("x")).join(F.broadcast(picked), "k")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "x"):
            cells, bounds = features(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([cells[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], type=pa.binary())], names=["k", "grade", "cells"])

    found = rows.mapInArrow(extract, f"k {rows.schema['k'].dataType.simpleString()}, grade int, cells binary")
    once = found.groupBy("k", "grade").agg(F.min("cells").alias("cells"))  # a repeated key trains with one of its texts
    room = Window.orderBy(F.xxhash64("k"), "k", "grade").rowsBetween(Window.unboundedPreceding, 0)  # over at most ``sample`` rows
    got = once.withColumn("used", F.sum(F.octet_length("cells")).over(room)).where(F.col("used") <= SAMPLE_BYTES).collect()
    got.sort(key=lambda r: (r["k"], r["grade"], r["cells"]))
    return CumulativeLink().fit([np.frombuffer(r["cells"], dtype=np.int32) for r in got], np.array([r["grade"] for r in got], dtype=np.int64))


def score(docs: DataFrame, model: CumulativeLink, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, expected_grade, p_tail (highest grade) and selected of every document."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CumulativeLink(*sent.value)
        for batch in chunks(batches, "x"):
            expected, tail = own.score(*features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(expected, 6)), pa.array(np.round(tail, 6))], names=["doc_id", "expected_grade", "p_tail"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("x"))
    return rows.mapInArrow(rate, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_grade double, p_tail double").withColumn(
        "selected", F.col("p_tail") >= SELECT)
