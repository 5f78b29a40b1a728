"""Pruned sparse scoring and blockwise dense scoring against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tabloom.operators import retrieve as R
from tabloom.operators import scoring


def brute_sparse(pages, queries, k):
    """{(query, source): [(page, score)]} by the stated TF-IDF."""
    out = {}
    for source in {s for s, _, _ in pages}:
        docs = [(p, Counter(t.split())) for s, p, t in pages if s == source]
        df = Counter(w for _, c in docs for w in c)
        idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
        for q, text in queries:
            qtf = Counter(text.split())
            qn = math.sqrt(sum((n * idf[w]) ** 2 for w, n in qtf.items() if w in idf))
            ranked = []
            for p, c in docs:
                norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
                raw = sum(c[w] * idf[w] / norm * n * idf[w] for w, n in qtf.items() if w in c) if norm else 0.0
                ranked.append((-round(raw, 9), p, raw / qn if qn else 0.0))
            out[q, source] = [(p, s) for _, p, s in sorted(ranked)[:k]]
    return out


def corpus():
    rng = random.Random(21)
    words = [f"w{i}" for i in range(40)]
    zipf = [1 / (i + 1) for i in range(40)]
    pages = [("big", p, " ".join(rng.choices(words, zipf, k=rng.randint(0, 25)))) for p in range(700)]
    pages += [("big", 1000 + p, pages[p][2]) for p in range(5)]  # copies tie
    pages += [(f"s{i}", p, " ".join(rng.choices(words, zipf, k=5))) for i in range(6) for p in range(rng.randint(1, 4))]
    queries = [(q, " ".join(rng.choices(words, zipf, k=6))) for q in range(12)] + [(20, "w0 w1 w39"), (21, "unknown"), (22, "")]
    return pages, queries


def test_sparse_topk_is_exact_in_one_and_many_cells(spark, monkeypatch):
    pages, queries = corpus()
    chunks = spark.createDataFrame(pages, "source string, page int, content string")
    q = spark.createDataFrame(queries, "query_id int, text string")
    want = brute_sparse(pages, queries, 4)

    def check():
        got = {}
        for r in R.sparse_topk(q, R.tfidf_fit(chunks), 4).orderBy("rank").collect():
            got.setdefault((r.query_id, r.source), []).append((r.page, r.score))
        assert set(got) == set(want)
        for key, rows in want.items():
            assert [p for p, _ in got[key]] == [p for p, _ in rows], key
            assert np.allclose([s for _, s in got[key]], [s for _, s in rows])

    check()
    monkeypatch.setattr(R, "CELL_DOCS", 50)
    monkeypatch.setattr(R, "QUERY_BLOCK_BYTES", 500)
    check()


def test_pruning_skips_documents_and_keeps_the_list():
    """Blocks and terms that cannot reach the k-th score are not added up."""
    rng = np.random.default_rng(3)
    rows = []
    for d in range(2000):
        rows.append(("g", d, "common", 0.01 + 0.001 * rng.random()))
        if d < 6 or d % 97 == 0:
            rows.append(("g", d, "rare", 0.5 + 0.4 * rng.random()))
    docs = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("source", "page", "term", "w"))})
    queries = pa.table({"query_id": [1, 1], "term": ["common", "rare"], "qtf": [1.0, 1.0]})
    offered = []
    plain = scoring.Best.offer

    def counted(self, rounded, ids, scores):
        offered.append(len(ids))
        plain(self, rounded, ids, scores)

    scoring.Best.offer = counted
    try:
        out = scoring.sparse_cell(["source"], ["page"], 5, 9)(docs, queries).to_pylist()
    finally:
        scoring.Best.offer = plain
    total = Counter()
    for _, d, _, w in rows:
        total[d] += w
    assert [r["page"] for r in out] == [d for d, _ in sorted(total.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]]
    assert sum(offered) < 200 and len(total) == 2000


def test_lists_shorter_than_k_and_ties_go_by_key(spark):
    chunks = spark.createDataFrame([("s", p, "same text") for p in (5, 3, 9, 1)] + [("s", 7, None)], "source string, page int, content string")
    q = spark.createDataFrame([(1, "same"), (2, "none")], "query_id int, text string")
    got = [(r.query_id, r.page) for r in R.sparse_topk(q, R.tfidf_fit(chunks), 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 3), (1, 5), (2, 1), (2, 3), (2, 5)]
    assert R.sparse_topk(q.where("false"), R.tfidf_fit(chunks), 3).count() == 0
    assert R.sparse_topk(q, R.tfidf_fit(chunks.where("false")), 3).count() == 0
    vecs = spark.createDataFrame([("s", p, [1.0, 0.0]) for p in (5, 3, 9)] + [("s", 1, [0.0, 0.0]), ("s", 2, None)], "source string, page int, embedding array<float>")
    qv = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id int, embedding array<float>")
    assert [(r.query_id, r.page) for r in R.dense_topk(qv, vecs, 2).orderBy("rank").collect()] == [(1, 3), (1, 5)]
    assert R.dense_topk(qv.where("false"), vecs, 2).count() == 0 and R.dense_topk(qv, vecs.where("false"), 2).count() == 0


def test_fit_moves_texts_not_uncounted_term_rows(spark, tmp_path):
    import re

    chunks = spark.createDataFrame([("s", 0, "one two two"), ("s", 1, "two three"), ("t", 0, None), ("t", 1, "one one four"), (None, 0, "five five")],
                                   "source string, page long, content string")
    model = R.tfidf_fit(chunks, ["source"], ["page"])
    plan = model.weights._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(source#\d+, page#\d+L, term#", plan)
    R.tfidf_store(chunks, f"{tmp_path}/fit", ["source"], ["page"])
    stored = R.TfidfModel.load(spark, f"{tmp_path}/fit", ["source"], ["page"])
    for a, b in ((model.weights, stored.weights), (model.idf, stored.idf), (model.docs, stored.docs)):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
    assert {(r.source, r.term): round(r.idf, 4) for r in stored.idf.collect()}["s", "two"] == 1.0
