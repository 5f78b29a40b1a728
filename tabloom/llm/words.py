"""Vectorised words of Arrow text batches, for the operators that run numpy inside tasks.

A word is a maximal run of characters outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F`` after
A-Z are lowered: ASCII letters, digits and everything beyond ASCII.  All bytes of a
multi-byte UTF-8 character lie above 7F, so the byte view is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text bytes handled at once (a longer single text is handled alone).
CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
#: Bytes whose power sums are held at once (a longer range is summed piece by piece).
WINDOW = 1 << 18
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS, _INVERSES = (np.cumprod(np.concatenate((np.ones(1, dtype=U), np.full(WINDOW, b, dtype=U))), dtype=U) for b in (_BASE, _INVERSE))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (one-to-one)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def range_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Per range of bytes (ascending, apart): the sum of (byte + 1) times a power of its place in the range."""
    out = np.zeros(len(start), dtype=U)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = int(np.searchsorted(end, base + WINDOW, side="right"))  # ranges that end within the window
        if j > i:
            part = data[base: int(end[j - 1])]
            sums = np.zeros(len(part) + 1, dtype=U)
            np.cumsum((part.astype(U) + U(1)) * _POWERS[: len(part)], dtype=U, out=sums[1:])
            out[i:j] = (sums[end[i:j] - base] - sums[start[i:j] - base]) * _INVERSES[start[i:j] - base]
            i = j
        else:
            total, power = 0, 1
            for at in range(base, int(end[i]), WINDOW):
                part = data[at: min(at + WINDOW, int(end[i]))]
                total += power * int(((part.astype(U) + U(1)) * _POWERS[: len(part)]).sum(dtype=U))
                power = power * pow(_BASE, len(part), 1 << 64) % (1 << 64)
            out[i] = total % (1 << 64)
            i += 1
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of text."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of a text array: hash, owning row, byte bounds in ``data`` (lowered)."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset:]
        raw = texts.buffers()[2]
        lo, hi = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        data = np.frombuffer(raw, dtype=np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, dtype=np.uint8)
        offsets = offsets - lo
        self.rows, self.data = len(texts), _LOWER[data]
        inside = _WORD[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        real = offsets[:-1][offsets[1:] > offsets[:-1]]  # a text starts and another ends here
        first[real] = inside[real]
        last[real[1:] - 1] = inside[real[1:] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        at = np.searchsorted(self.start, offsets)
        self.first, self.count = at[:-1], np.diff(at)  # by row
        self.row = np.repeat(np.arange(self.rows), self.count)
        self.hash = mix(range_sums(self.data, self.start, self.end) + (self.end - self.start).astype(U))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of every run of ``k`` words within one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
        h = self.hash[:n].copy()
        for j in range(1, k):
            h = h * U(0xD6E8FEB86659FD93) + self.hash[j: n + j]
        at = np.flatnonzero(self.row[:n] == self.row[k - 1:])
        return mix(h[at]), at

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of all k-word shingles; a shorter text that has words is one shingle."""
        h, at = self.grams(k)
        rows = self.row[at]
        for m in range(1, k):
            if (short := np.flatnonzero(self.count == m)).size:
                g, first = self.grams(m)
                own = np.isin(first, self.first[short])
                h, rows = np.concatenate((h, g[own])), np.concatenate((rows, self.row[first[own]]))
        order = np.argsort(rows, kind="stable") if rows.size and (np.diff(rows) < 0).any() else slice(None)
        return h[order], rows[order]

    def text(self, first: int, count: int) -> bytes:
        """Words joined by a space, for exact comparison."""
        return b" ".join(self.data[self.start[i]: self.end[i]].tobytes() for i in range(first, first + count))
