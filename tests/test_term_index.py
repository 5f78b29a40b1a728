"""An index kept up to date equals one fit over the documents at hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabloom.operators import retrieve as R
from tabloom.operators.term_index import TermIndex

CHUNKS = "source string, page int, content string"


def weights(model):
    return {(r.source, r.page, r.term): (round(r.idf, 9), round(r.wn, 9)) for r in model.weights.collect()}


def same(model, chunks):
    full = R.tfidf_fit(chunks, ["source"], ["page"])
    assert weights(model) == weights(full)
    pick = lambda m: sorted((r.source, r.page) for r in m.docs.collect())
    assert pick(model) == pick(full)
    words = lambda m: {(r.source, r.term, round(r.idf, 9)) for r in m.idf.collect()}
    assert words(model) == words(full)


def rows(n, seed):
    rng = random.Random(seed)
    return [("st"[i % 2], i, " ".join(rng.choice("alpha beta gamma delta omega pi rho".split()) for _ in range(rng.randrange(9)))) for i in range(n)]


def test_increments_equal_a_full_fit(spark, tmp_path):
    every = [*rows(30, 3), ("s", 50, None), ("s", 51, ""), ("t", 52, "alpha alpha")]
    frame = lambda x: spark.createDataFrame(x, CHUNKS)
    index = TermIndex.create(frame(every[:12]), str(tmp_path / "a"))
    same(index.model(), frame(every[:12]))
    index.add(frame(every[6:20]).withColumn("term", F.lit("extra")).withColumn("n", F.lit(9)), 1)  # six of them known
    index.add(frame(every[20:]), 2)
    same(index.model(), frame(every))
    index.remove(frame(every[4:9] + [("zz", 1, "unknown")]).select("source", "page"), 3)
    same(index.model(), frame(every[:4] + every[9:]))
    index.add(frame([(s, p, "rho again") for s, p, _ in every[4:6]]), 4)
    now = every[:4] + [(s, p, "rho again") for s, p, _ in every[4:6]] + every[9:]
    same(index.model(), frame(now))
    small = index.compact(str(tmp_path / "b"))
    same(small.model(), frame(now))
    small.add(frame([("u", 1, "new word")]), 5)
    same(small.model(), frame([*now, ("u", 1, "new word")]))


def test_a_batch_run_again_stores_the_same_rows(spark, tmp_path):
    every = rows(20, 5)
    frame = lambda x: spark.createDataFrame(x, CHUNKS)
    index = TermIndex.create(frame([]), str(tmp_path / "a"))
    assert index.model().docs.count() == 0
    for _ in range(2):
        index.add(frame(every[:15]), 1)
    for _ in range(2):
        index.remove(frame(every[2:5]).select("source", "page"), 2)
    for _ in range(2):
        index.add(frame(every), 3)
    same(index.model(), frame(every))
    with pytest.raises(Exception, match="share one key"):
        index.add(frame([("q", 1, "a"), ("q", 1, "b")]), 4)
    same(index.model(), frame(every))


def test_a_stream_keeps_the_index(spark, tmp_path):
    every = rows(24, 8)
    frame = lambda x: spark.createDataFrame(x, CHUNKS)
    index = TermIndex.create(frame([]), str(tmp_path / "a"), batch=-1)
    for part in (every[:10], every[5:24]):
        frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(lambda df, n: index.add(df, n)).option(
            "checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    same(index.model(), frame(every))


def test_a_batch_moves_texts_not_term_rows(spark, tmp_path):
    frame = lambda x: spark.createDataFrame(x, CHUNKS)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    every = [(None, 1, "one two two"), (None, None, "two three"), ("s", None, "one"), ("s", 2, None)]
    index = TermIndex.create(frame(every[:2]), str(tmp_path / "a"))
    counts = dict(index._counts(frame(every), "content", index._live("doc", 1)))
    exchanges = [x for x in plan(counts["tf"]).split("\n") if "Exchange hashpartitioning" in x]
    assert exchanges and not any("term#" in x for x in exchanges)
    assert sorted((r.source, r.page or 0, r.term, r.n) for r in counts["tf"].collect()) == [("s", 0, "one", 1)]  # null keys are known
    index.remove(frame(every[:1]).select("source", "page"), 1)
    assert "Exchange hashpartitioning" not in plan(index._live("tf")).split("BroadcastExchange")[0]
    assert [(r.page, r.term) for r in index._live("tf").orderBy("term").collect()] == [(None, "three"), (None, "two")]
    index.add(frame(every), 2)
    kept = index.model().checkpoint()
    assert kept.weights.inputFiles() and weights(kept) == weights(index.model())
    assert kept.docs.count() == 4
