"""Stored hits: a second run scores only what the first has not."""

from __future__ import annotations

import random

import pytest

from tabloom.operators import hits as H
from tabloom.operators import retrieve as R

VECS, QUERIES = "source string, page int, embedding array<float>", "query_id int, embedding array<float>"


def rows(df):
    return sorted((r.query_id, r.source, r["rank"], r.page, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("score", ["distance", "similarity"])
def test_second_run_equals_a_full_run_and_scores_new_rows_only(spark, tmp_path, monkeypatch, score):
    rng = random.Random(9)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    first = [("s" if i % 3 else "t", i, vec()) for i in range(40)]
    added = [("s" if i % 2 else "u", i, vec()) for i in range(40, 55)] + [("s", 60, first[1][2])]
    asked = [(i, vec()) for i in range(6)]
    more = asked + [(7, vec()), (8, asked[0][1]), (9, None), (10, [0.0] * 6)]
    frame = lambda x, s: spark.createDataFrame(x, s)
    out, store = H.ask(frame(asked, QUERIES), frame(first, VECS), k=4, score=score)
    assert rows(out) == rows(R.dense_topk(frame(asked, QUERIES), frame(first, VECS), 4, score=score))
    store.save(str(tmp_path / "one"))

    calls = []
    plain = H.dense_topk
    monkeypatch.setattr(H, "dense_topk", lambda q, v, *a, **kw: calls.append((q.count(), v.count())) or plain(q, v, *a, **kw))
    every = frame(first + added, VECS)
    out, again = H.ask(frame(more, QUERIES), every, H.Hits.load(spark, str(tmp_path / "one")), 4, score=score)
    assert rows(out) == rows(plain(frame(more, QUERIES), every, 4, score=score))
    assert calls == [(6, len(added)), (2, len(first + added))]
    again.save(str(tmp_path / "two"))

    # a lost document, and a longer list than was kept, are scored anew
    store = H.Hits.load(spark, str(tmp_path / "two"))
    left = frame([r for r in first + added if r[1] % 5], VECS)
    assert rows(H.ask(frame(more, QUERIES), left, store, 4, score=score)[0]) == rows(plain(frame(more, QUERIES), left, 4, score=score))
    assert rows(H.ask(frame(asked, QUERIES), every, store, 6, score=score)[0]) == rows(plain(frame(asked, QUERIES), every, 6, score=score))
    # another filter is another question
    calls.clear()
    H.ask(frame(asked, QUERIES), every, store, 4, score=score, filters="x")
    assert calls == [(0, 0), (6, len(first + added))]
