"""Token counts by heap-and-linked-list byte-pair merging, without identifiers.

A word starts as one symbol per mapped byte.  All adjacent pairs with a merge rank go on a
heap; the lowest rank (leftmost on ties) is popped again and again, its two symbols are
joined in a linked list, and the new neighbours' pairs are pushed.  A popped entry whose
symbols have changed is stale and skipped.  The count is symbols minus merges.

Texts are cut at spaces and line ends, which no token of the vocabulary crosses.  The distinct
pieces of a batch that the worker's bounded table lacks are normalised together by the tokenizer file's
normalizer and cut by its pattern, and each of their distinct words is merged once.  One
narrow pass, no shuffle.

Defined cases: null and empty texts have no tokens; the file's added tokens inside a text
count as one each, as in the library's default; texts and words of any length are counted
whole.  Each row gets its result, whatever repeats.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .piece_table import TABLE_CHARS, TABLE_ROWS, PieceTable
from .words import chunks

#: Text bytes whose new pieces are computed together.
BATCH_BYTES = 4 << 20
#: Documents with more tokens are over the limit.
LIMIT = 2048
#: Below this code point all Unicode versions agree on letters and numbers.
_OLD = "\u0250"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class Merges:
    """The merge ranks of a byte-pair vocabulary, by symbol numbers."""

    def __init__(self, model: dict):
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        number: dict[str, int] = {}
        self._number = lambda s: number.setdefault(s, len(number))
        kept = model.get("unk_token") is not None  # else the library leaves out symbols without an entry
        edge = lambda s: self._number(s) if kept or s in vocab else -1
        self.inner = [edge(c) for c in byte_characters()]
        self.last = [edge(c + suffix) for c in byte_characters()]
        triples = [(self._number(a), self._number(b), self._number(a + b)) for a, b in pairs]
        self.step = len(number)
        self.rank = {a * self.step + b: r for r, (a, b, _) in enumerate(triples)}
        self.merged = [c for _, _, c in triples]

    def count(self, word: bytes) -> int:
        """Tokens of one word."""
        inner, rank, step, merged = self.inner, self.rank.get, self.step, self.merged
        symbols = [inner[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        if -1 in symbols:
            symbols = [s for s in symbols if s >= 0]
        n = len(symbols)
        if n < 2:
            return n
        # the rank of the pair that begins at each symbol; -1 where no merge joins it
        ranks = [rank(a * step + b, -1) for a, b in zip(symbols, symbols[1:])]
        ranks.append(-1)
        heap = [r * n + i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return n
        heapify(heap)
        after, before, left = [*range(1, n + 1)], [*range(-1, n - 1)], n
        while heap:
            r, i = divmod(heappop(heap), n)
            if ranks[i] != r:
                continue  # stale
            j = after[i]
            symbols[i] = s = merged[r]
            ranks[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                ranks[i] = r = rank(s * step + symbols[k], -1)
                if r >= 0:
                    heappush(heap, r * n + i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                ranks[h] = r = rank(symbols[h] * step + s, -1)
                if r >= 0:
                    heappush(heap, r * n + h)
        return left


class Counts:
    """Tokens of pieces of text between blanks."""

    def __init__(self, path: str, rows: int = TABLE_ROWS):
        spec, library = json.load(open(path, encoding="utf-8")), Tokenizer.from_file(path)
        parts = spec["pre_tokenizer"].get("pretokenizers", [])
        if [p["type"] for p in parts] != ["Split", "ByteLevel"] or parts[0]["behavior"] != "Removed" or not parts[0]["invert"] or (
                parts[1]["use_regex"] or parts[1]["add_prefix_space"]):
            raise ValueError(f"{path}: words are not the matches of a pattern, as bytes")
        self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
        self.normal, self.pre = library.normalizer, library.pre_tokenizer
        self.byte = {c: b for b, c in enumerate(byte_characters())}
        self.merges = Merges(spec["model"])
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(f"(?:{re.escape(a)})" for a in added)) if added else None
        if any(re.search(r"\s", a) for a in added) or any(t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with blanks, or matched after normalising")
        self.words: dict[bytes, int] = {}
        self.table = PieceTable(self.fill, rows)

    def fill(self, pieces: list[str]) -> list[int]:
        """Tokens of distinct pieces."""
        marked = {p for p in pieces if self.added and self.added.search(p)}
        whole = [p for p in pieces if p not in marked]
        inside = [x for p in marked for x in self.added.split(p)]
        tokens = dict(zip(whole + inside, map(self._tokens, self.words_of(whole + inside))))
        if len(self.words) > self.table.rows:
            self.words = {}
        return [tokens[p] if p not in marked else
                len(self.added.findall(p)) + sum(tokens[x] for x in self.added.split(p)) for p in pieces]

    def words_of(self, texts: list[str]) -> list[list[bytes]]:
        """The words of every text, as bytes."""
        plain = [x for x in texts if len(x.split()) == 1 and not x[0].isspace() and not x[-1].isspace()]
        normal = self.normal.normalize_str(" ".join(plain)).split(" ") if self.normal else plain
        if len(normal) != len(plain):  # a normalizer that makes blanks: one by one
            plain, normal = [], []
        known, found = dict(zip(plain, normal)), {}
        easy = [x for x in dict.fromkeys(normal) if x and max(x) < _OLD]
        made = iter(self.pattern.findall(" ".join(easy)))
        for text in easy:
            words, need = [], len(text)
            while need:
                words.append(next(made))
                need -= len(words[-1])
            found[text] = [w.encode() for w in words]

        def one(text: str) -> list[bytes]:
            own = known.get(text)
            if own is None:
                own = self.normal.normalize_str(text) if self.normal else text
            if own not in found:
                found[own] = [bytes(map(self.byte.__getitem__, w)) for w, _ in self.pre.pre_tokenize_str(own)] if own else []
            return found[own]

        return [one(x) for x in texts]

    def _tokens(self, words: list[bytes]) -> int:
        n, known = 0, self.words
        for word in words:
            tokens = known.get(word)
            if tokens is None:
                tokens = self.merges.count(word)
                if len(word) <= TABLE_CHARS:
                    known[word] = tokens
            n += tokens
        return n

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of every text."""
        rows = [(x or "").replace("\n", " ").split(" ") for x in texts]
        value = self.table.look_up(set().union(*rows)).__getitem__
        return [sum(map(value, parts)) for parts in rows]


_counts: dict[str, Counts] = {}


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counts:
            _counts[path] = Counts(path)
        for batch in chunks(batches, "x", BATCH_BYTES):
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            tokens = pa.array(_counts[path].count(batch.column(1).to_pylist()), type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, tokens], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every text; ``path`` is a tokenizers file on each executor."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("x"))
    return rows.mapInArrow(_counter(path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint").withColumn(
        "over_limit", F.col("n_tokens") > limit)
