"""Recursive splitting against a plain statement of the same rule."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions.packing import packed_chunks


def pack(pieces, size, overlap):
    out, open_ = [], []
    for piece in pieces:
        if open_ and sum(map(len, open_)) + len(piece) > size:
            out.append("".join(open_))
            while open_ and (sum(map(len, open_)) > overlap or sum(map(len, open_)) + len(piece) > size):
                open_.pop(0)
        open_.append(piece)
    return out + ["".join(open_)] * bool(open_)


def split(text, size, overlap, separators=("\n\n", "\n", " ")):
    if not separators:
        return pack(text, size, overlap)
    first, *others = text.split(separators[0])
    out, run = [], []
    for piece in filter(None, [first, *(separators[0] + x for x in others)]):
        if len(piece) < size:
            run.append(piece)
            continue
        out += pack(run, size, overlap) + split(piece, size, overlap, separators[1:])
        run = []
    return out + pack(run, size, overlap)


def test_examples(spark):
    rows = [("aaaa bbbb cccc dddd", 10, 3, ["aaaa bbbb", "cccc dddd"]), ("p1 line\n\np2 is here", 12, 0, ["p1 line", "p2 is here"]),
            ("abcdefghij", 4, 1, ["abcd", "defg", "ghij"]), ("", 4, 1, []), (" \n\n 　 ", 4, 1, []), (None, 4, 1, None)]
    for text, size, overlap, want in rows:
        frame = spark.createDataFrame([(text,)], "text string")
        assert frame.select(packed_chunks(F.col("text"), size, overlap).alias("c")).first()["c"] == want, text


@pytest.mark.parametrize("size,overlap", [(5, 0), (7, 3), (12, 4), (20, 19), (16, 30), (2, 1)])
def test_matches_the_rule(spark, size, overlap):
    rng = random.Random(size)
    texts = ["".join(rng.choice(["a", "bc", "é😀", "wordy", "\n", "\n\n", " ", "  ", "\t", "x" * 17]) for _ in range(rng.randrange(60))) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", packed_chunks(F.col("text"), size, overlap).alias("c"))
    want = {i: [c.strip() for c in split(t, size, overlap) if c.strip()] for i, t in enumerate(texts)}
    assert {r.i: r.c for r in frame.collect()} == want


def test_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000)) + "\n" + "z" * 50_000
    got = spark.createDataFrame([(text,)], "text string").select(packed_chunks(F.col("text"), 4000, 200).alias("c")).first()["c"]
    assert max(map(len, got)) <= 4000 and got[0].startswith("w0 w1 ") and got[-1] == "z" * len(got[-1])
    assert {w for c in got for w in c.split()} >= {f"w{i}" for i in range(300_000)}
