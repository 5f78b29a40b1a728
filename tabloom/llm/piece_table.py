"""A table of distinct text pieces in a Python worker, filled batch by batch.

The pieces of a batch that the table lacks are computed together, each once.  When the table
passes its bound it keeps the pieces of the batch at hand, among them those that nearly every
batch holds, and forgets the others; a forgotten piece is only computed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Distinct pieces a worker keeps, and the longest it keeps.
TABLE_ROWS, TABLE_CHARS = 1_000_000, 64


class PieceTable:
    """piece -> value; ``fill`` computes the values of a list of distinct pieces."""

    def __init__(self, fill: Callable[[list[str]], Iterable], rows: int = TABLE_ROWS):
        self.fill, self.rows, self.values = fill, rows, {}
        self.found = self.computed = 0

    def look_up(self, pieces: set[str]) -> dict:
        """A mapping that has every one of ``pieces``; valid until the next call."""
        missing = list(pieces.difference(self.values))
        self.found += len(pieces) - len(missing)
        self.computed += len(missing)
        self.values.update(zip(missing, self.fill(missing)))
        out = self.values
        if len(out) > self.rows:
            self.values = {p: out[p] for p in pieces if len(p) <= TABLE_CHARS}
        elif missing and max(map(len, missing)) > TABLE_CHARS:
            self.values = {p: v for p, v in out.items() if len(p) <= TABLE_CHARS}
        return out
