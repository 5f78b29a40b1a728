"""The trie codec against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm import piece_table, queries, trie_codec

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
BITS = ["a", "aa", "aaa", "the", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "\x1c", "\x85", "é", "日本", "😀", "'s", "'", "n't", "123",
        "<|endoftext|>", "<|endoftext", "...", "_", "ß", "İ", "́", "###", "x" * 30, "\x00", " a", " the", "ing", "　", " "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(codec, library, texts):
    want = library.encode_batch([x or "" for x in texts], add_special_tokens=False)
    for x, (ids, text), w in zip(texts, codec.encode(texts), want):
        assert memoryview(ids).cast("I").tolist() == w.ids, repr((x or "")[:80])
        assert text == library.decode(w.ids, skip_special_tokens=False)


def test_random_texts_equal_the_library(library):
    rng = random.Random(3)
    texts = [None, "", "x" * 70_000, "w " * 20_000, "ab" * 3000] + ["".join(rng.choices(BITS, k=rng.randint(1, 25))) for _ in range(8000)]
    texts += ["".join(map(chr, rng.choices([*range(0, 0xD800), *range(0xE000, 0x2FFFF)], k=12))) for _ in range(500)]
    check(trie_codec.Codec(PATH), library, texts)


def test_small_tables_give_the_same(library):
    rng = random.Random(4)
    codec = trie_codec.Codec(PATH, rows=20)
    for _ in range(30):
        check(codec, library, [" ".join(rng.choices(["the", "then", "there", "thereby", "antler", "日本語", "x" * 100], k=9)) + str(rng.random()) for _ in range(20)])
    assert len(codec.table.values) < 400 and all(len(p) <= piece_table.TABLE_CHARS for p in codec.table.values)


def test_every_pair_verdict_equals_an_encoding(library):
    """Two tokens stay apart exactly when the library encodes their text as these two."""
    rng = random.Random(5)
    codec = trie_codec.Codec(PATH)
    tokens = codec.tokens
    letters = [(s, t) for s, t in tokens.id.items() if s.isascii() and s.isalpha()]
    seen = set()
    for _ in range(20_000):
        (a, i), (b, j) = rng.choice(letters), rng.choice(letters)
        got = tokens.apart(i, j)
        seen.add(got)
        assert got == (library.encode(a + b, add_special_tokens=False).ids == [i, j]), (a, b)
    assert seen == {True, False}
    assert all(tokens.whole(t) == (library.encode(s, add_special_tokens=False).ids == [t]) for s, t in letters[::20])


def test_shared_prefixes_are_computed_once():
    trie = trie_codec.Codec(PATH).trie
    words = ["inter", "internal", "internally", "internet", "inters", "into"]
    list(trie.encode(words))
    assert trie.nodes == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_query_rows_and_round_trip(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_trie_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    odd = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, ""), (3, "<|endoftext|> é\n")], "doc_id long, text string").withColumn("x", F.lit(1))
    both = trie_codec.encode(odd, PATH, ("n_tokens", "ids", "decoded"))
    assert sorted((r.doc_id or 0, r.decoded) for r in both.collect()) == [(0, "a b"), (1, ""), (1, ""), (2, ""), (3, "<|endoftext|> é\n")]
    assert sorted((r.doc_id or 0, r.decoded) for r in trie_codec.decode(both, PATH).collect()) == sorted((r.doc_id or 0, r.decoded) for r in both.collect())
    assert trie_codec.encode(odd.where("false"), PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        trie_codec.Codec(public_tokenizers.path("word_bpe_49k.json"))
