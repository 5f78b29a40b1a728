"""Quality rules: n-gram log-likelihood ratio of trusted-target against raw-corpus text.

Two multinomials over ``CELLS`` hash cells of one- and two-word n-grams are counted over every
text: one from the trusted documents, one from all documents.  The cells are as many at every
corpus size, so a task hands on at most that many counts and the weights are a broadcast of known size.
A document's score is the mean over its n-grams of ``ln p_target - ln p_raw``; it is kept when
the score reaches the threshold and the base rules pass.  DataFrame functions only.

The threshold follows the corpus: trusted texts are dealt into ``FOLDS`` parts by a hash, so
that copies share a part; each trusted document that passes the base rules is scored with the
target counts of the other parts, and the ``QUANTILE`` of these scores over all of them is the threshold.

Two scans of the texts: one counts cells (combined in the task, then by cell), the other
measures, explodes each text's n-grams, looks up their weights and sums them in the task again,
so that one small row per document moves.

Defined cases: a null or empty text has no words, fails the base rules and scores 0.  Without
trusted text every score is 0 and, as when all trusted text is in one part, only the base
rules decide.  Repeated rows count as often as they occur and each gets its own result row.  Null
keys are kept and never trusted.  Extra columns are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpoint_dir
from .exprs import let, neighbours, words_of

#: Cells of each multinomial (a power of two) and the count added to every cell.
CELLS, SMOOTHING = 1 << 18, 1.0
#: Words of an n-gram.
ORDERS = (1, 2)
#: Parts of the trusted texts; each is scored without its own.
FOLDS = 4
#: Share of the trusted documents that the threshold may reject.
QUANTILE = 0.02
#: The base rules: words of a window, least words, largest share of repeated words in percent.
WINDOW, MIN_WORDS, MAX_REPEAT_PCT = 8, 20, 30
#: Trusted keys and rejected texts are broadcast up to this many bytes (16 a row); beyond, Spark's planner decides.
BROADCAST_BYTES = 32 << 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _mix(a: Column, b: Column, by: int) -> Column:
    return F.shiftleft(a, by).bitwiseXOR(b)


def _cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit(CELLS - 1)).cast("int")


def repeated_words(hashes: Column, two: Column) -> Column:
    """Words inside windows of eight words found twice or more; from the hashes of words and of pairs.

    Hashes of four and eight words come from those of two.  Only texts with a repeated
    four-word hash go on to windows of eight, and only those with a repeated window are sorted.
    """
    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        gaps = lambda p: neighbours(p, 1, lambda a, b: F.least(F.lit(WINDOW), b - a))
        return let(let(ordered, starts), lambda p: F.lit(WINDOW) + F.aggregate(gaps(p), F.lit(0), lambda s, x: s + x))

    def starts(ordered: Column) -> Column:
        """First words of the windows whose hash a neighbour in hash order shares, ascending."""
        both = F.flatten(neighbours(ordered, 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
        return F.sort_array(F.array_distinct(both))

    distinct = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    eight = lambda h4: let(neighbours(h4, 4, lambda a, b: _mix(a, b, 4)), lambda h: F.when(distinct(h), 0).otherwise(covered(h)))
    return F.when(F.size(hashes) <= WINDOW, 0).otherwise(let(
        neighbours(two, 2, lambda a, b: _mix(a, b, 2)), lambda h4: F.when(distinct(h4), 0).otherwise(eight(h4))))


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast when the rows, of two longs, are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_BYTES // 16 + 1).count() * 16 <= BROADCAST_BYTES else rows


def marked(docs: DataFrame, trusted: DataFrame, text: str, key: str) -> DataFrame:
    """(k, x, h, fold): keys and texts, their hash, and the part of those of trusted documents (else null)."""
    ids = _small(trusted.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).distinct().withColumn("t", F.lit(1)))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("x"), F.xxhash64(F.col(text)).alias("h")).join(ids, "k", "left")
    return rows.select("k", "x", "h", F.when(F.col("t").isNotNull(), F.pmod("h", F.lit(FOLDS)).cast("int")).alias("fold"))


def count_cells(texts: DataFrame) -> DataFrame:
    """(b, raw, tgt_0 ... ): n-grams per cell of all texts and of every part of the trusted ones; combinable."""
    words = texts.select("fold", words_of(F.col("x")).alias("w"))
    after = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = words.select("fold", F.inline(F.arrays_zip(F.col("w").alias("a"), after.alias("b")))).select(
        "fold", F.xxhash64("a").alias("a"), F.when(F.col("b").isNotNull(), F.xxhash64("b")).alias("b"))
    grams = [F.col("a")] * (1 in ORDERS) + [_mix(F.col("a"), F.col("b"), 1)] * (2 in ORDERS)
    cells = pairs.select("fold", F.explode(F.array(*map(_cell, grams))).alias("b")).where(F.col("b").isNotNull())
    return cells.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), *[F.count_if(F.col("fold") == f).alias(f"tgt_{f}") for f in range(FOLDS)])


def weights_of(counts: DataFrame) -> tuple[DataFrame, list[float | None]]:
    """Per cell its weight ``w`` and the weights ``w_0 ...`` without one part; and those of a cell without counts.

    A weight whose target is empty is null; the first is 0 then.
    """
    total = counts.agg(F.sum("raw").alias("raw"), *[F.sum(f"tgt_{f}").alias(f"tgt_{f}") for f in range(FOLDS)]).first()
    parts = [total[f"tgt_{f}"] or 0 for f in range(FOLDS)]
    target = sum(parts)

    def ratio(n: Column, raw: Column, of: int) -> Column:
        if not of:
            return F.lit(None).cast("double")
        p = lambda c, size: F.log((c + F.lit(SMOOTHING)) / F.lit(size + SMOOTHING * CELLS))
        return p(n, of) - p(raw, total.raw)

    def weights(rows: DataFrame) -> DataFrame:
        own = [F.col(f"tgt_{f}") for f in range(FOLDS)]
        every = sum(own[1:], own[0])
        return rows.select("b", F.coalesce(ratio(every, F.col("raw"), target), F.lit(0.0)).alias("w"),
                           *[ratio(every - own[f], F.col("raw"), target - parts[f]).alias(f"w_{f}") for f in range(FOLDS)])

    none = counts.sparkSession.range(1).select(F.lit(0).alias("b"), F.lit(0).alias("raw"), *[F.lit(0).alias(f"tgt_{f}") for f in range(FOLDS)])
    return weights(counts), list(weights(none).first())[1:]


def base_failed(n: Column, repeated: Column) -> Column:
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PCT * n)


def measures(text: Column) -> Column:
    """Struct of all measures of one text and the cells of its n-grams."""
    x = F.coalesce(text, F.lit(""))

    def hashed(w: Column) -> Column:
        return let(F.transform(w, lambda a: F.xxhash64(a)), lambda h: let(neighbours(h, 1, lambda a, b: _mix(a, b, 1)), lambda h2: measured(w, h, h2)))

    def measured(w: Column, h: Column, h2: Column) -> Column:
        grams = [g for k, g in ((1, h), (2, h2)) if k in ORDERS]
        lines = F.filter(F.split(x, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(h).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(x, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"),
            repeated_words(h, h2).cast("long").alias("n_repeat_words"),
            F.transform(grams[0] if len(grams) == 1 else F.concat(*grams), _cell).alias("cells"))

    return let(words_of(x), hashed)


def rate(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", threshold: float | None = None) -> DataFrame:
    """The key (under its name), text_hash, the measures, base_failed, kept and llr_per_ngram of every row.

    A threshold of None is derived.  Runs the fitting jobs when called.
    """
    checkpoint_dir(docs.sparkSession)
    texts = marked(docs, trusted, text, key)
    weights, none = weights_of(count_cells(texts).checkpoint())
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "k", "h", "fold", measures(F.col("x")).alias("m"))
    grams = rows.select("row", "k", "h", "fold", *[f"m.{c}" for c in MEASURES], F.explode_outer("m.cells").alias("b"))
    held = F.coalesce(*[F.when(F.col("fold") == f, F.coalesce(f"w_{f}", F.lit(none[f + 1]))) for f in range(FOLDS)])
    found = F.when(F.col("b").isNotNull(), F.coalesce("w", F.lit(none[0])))
    scored = grams.join(F.broadcast(weights), "b", "left").groupBy("row", "k", "h", "fold", *MEASURES).agg(
        F.coalesce(F.avg(found), F.lit(0.0)).alias("llr_per_ngram"), F.avg(F.when(F.col("b").isNotNull(), held)).alias("held"))
    scored = scored.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))).checkpoint()
    if threshold is None:
        threshold = scored.where(~F.col("base_failed")).agg(F.percentile_approx("held", QUANTILE, 100_000)).first()[0]
    kept = ~F.col("base_failed") & (F.col("llr_per_ngram") >= F.lit(float("-inf") if threshold is None else threshold))
    return scored.select(F.col("k").alias(key), F.col("h").alias("text_hash"), *MEASURES, "base_failed", kept.alias("kept"), "llr_per_ngram")


def apply_rules(docs: DataFrame, trusted: DataFrame, text: str = "text", **params) -> DataFrame:
    """The documents that the rules keep, with their own columns; equal texts share a verdict."""
    good = _small(rate(docs, trusted, text, **params).where("kept").select(F.col("text_hash").alias("_kept_hash")).distinct())
    return docs.join(good, F.xxhash64(docs[text]) == F.col("_kept_hash"), "left_semi")
