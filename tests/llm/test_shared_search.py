"""Shared evaluation of many ranked searches against plain Python."""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm import shared_search as S

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    rows = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in rows), sum(len(t) for _, t in rows)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    df = {t: sum(t in own for _, own in rows) for t in set().union(*wanted.values())}
    out = set()
    for item, own in wanted.items():
        found = []
        for doc, words in rows:
            score = 0
            for t in own & set(words):
                tf, w = words.count(t), math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * len(words) * n_docs) // n_terms)))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out |= {(item, r + 1, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(found)[:k])}
    return out


def rows(df):
    return {tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()}


def test_search_equals_brute_force_in_one_and_many_blocks(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "É", "日本", "x1"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ".", "\n", " - "]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60)).replace("w1", "W1")) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "?!"), (None, text(30)), (5, docs[5][1]), (403, "w3 " * 5000), (404, docs[7][1])]
    common = text(12)
    items = [(i, common[: rng.randint(5, len(common))] + text(rng.randint(0, 15))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "nowhere"), (3, "w9 w8"), (53, "W9 w9 w8"), (54, "w8 w9")]
    d = spark.createDataFrame(docs, DOC).withColumn("n", F.lit(1)).withColumn("score", F.lit(2)).repartition(6)
    i = spark.createDataFrame(items, ITEM).withColumn("term", F.lit("x")).withColumn("block", F.lit(0))
    want = brute(docs, items, 7)
    assert rows(S.search(d, i, k=7)) == want
    assert rows(S.search(d, i, k=7, block_terms=40)) == want
    assert S.search(d, i.where("false")).count() == 0 and S.search(d.where("false"), i).count() == 0
    assert S.search(d, i, k=7).dtypes == S.search(d.where("false"), i).dtypes


def test_graph_shares_common_sets_and_keeps_the_sums():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 12)
        base = rng.sample(range(40), 8)
        items = [sorted(set(base[: rng.randint(0, 8)]) | set(rng.sample(range(40), rng.randint(0, 6)))) for _ in range(n)]
        graph = S.Graph(items, [rng.randint(0, 50) for _ in range(40)])
        members = [set(t) for t in graph.leaves]
        for a, b in graph.pairs:
            assert not members[a] & members[b]
            members.append(members[a] | members[b])
        for own, parts in zip(items, graph.items):
            assert sorted(t for p in parts for t in members[p]) == own
        # every node stands for terms that two items or more share
        assert all(sum(members[len(graph.leaves) + i] <= set(own) for own in items) >= 2 for i in range(len(graph.pairs)))
        assert graph.additions() <= sum(map(len, items))
        postings = {t: (np.arange(5), np.full(5, t + 1)) for t in range(0, 40, 2)}
        got = dict(S.evaluate(graph, graph.last_use(), postings, 5))
        for i, own in enumerate(items):
            want = sum(t + 1 for t in own if t % 2 == 0)
            assert (i in got) == (want > 0) and (not want or (got[i] == want).all())


def test_copies_of_an_item_are_evaluated_once():
    graph = S.Graph([[1, 2, 3], [1, 2, 3], [1, 2, 3, 4]], [9] * 5)
    assert graph.leaves == [[1, 2, 3], [4]] and graph.items == [[0], [0], [0, 1]] and not graph.pairs
