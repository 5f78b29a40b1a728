"""Byte-pair encoding and decoding by a traversal of the trie of distinct words.

The encoding of every prefix of a word is fixed by its last token: what comes before it is
the encoding of the shorter prefix.  So a trie node (a prefix) needs one token as its state.
Depth first, a node takes the token that ends there and stays apart from the last token of
the ancestor at which it begins; exactly one does.  Words that share a prefix share its nodes,
whose states are computed once.  A word's ids are read off by stepping back from its node.

Two tokens stay apart when no merge joins symbols across their boundary before both are
whole: the symbols at the boundary and the ranks between which each exists decide that,
without encoding anything.  That needs a vocabulary in which every token has one merge, ranked
after those of its halves; the file is checked when it is read.

Sorted, the distinct words are the trie in depth-first order: the path to a word is kept as a
stack of states, one per character, cut back to the prefix that the next word shares.

Texts are cut before blanks, which no token crosses; the file's own pre-tokenizer makes words
of the pieces.  Distinct pieces live in a bounded table in the Python worker, new ones
of a batch are encoded together, and ids and surfaces are joined back by position.  One narrow
pass, no shuffle: one table for the whole corpus would have to move every word occurrence.

Defined cases: null and empty texts have no ids and decode to the empty text; the file's added
tokens inside a text are single ids, as in the library's default; pieces of any length are
encoded whole.  Each row gets its result, whatever repeats.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .piece_table import TABLE_CHARS, TABLE_ROWS, PieceTable
from .token_count import byte_characters
from .words import chunks

#: Text bytes whose new words form one trie.
BATCH_BYTES = 8 << 20
#: Token pairs whose verdict a worker keeps.
PAIR_ROWS = 1_000_000
#: Result columns and their types.
OUTPUTS = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
NEVER = 1 << 60


class Tokens:
    """The tokens of a byte-pair vocabulary and which of them stay apart side by side."""

    def __init__(self, model: dict, raw: Callable[[str], str]):
        self.id: dict[str, int] = {raw(s): t for s, t in model["vocab"].items()}
        pairs = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        known = self.id.get
        self.rank = {(known(a), known(b)): r for r, (a, b) in enumerate(pairs)}
        self.halves = {known(a + b): (known(a), known(b), r) for r, (a, b) in enumerate(pairs)}
        born = {t: r for t, (_, _, r) in self.halves.items()}
        odd = model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout")
        if odd or model.get("ignore_merges") or None in born or len(born) < len(pairs) or any(
                r < max(born.get(a, -1), born.get(b, -1)) for a, b, r in self.halves.values()):
            raise ValueError("not a byte-pair vocabulary with one merge per token, ranked after its halves")
        self.longest = max(map(len, self.id))
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self.verdicts: dict[int, bool] = {}  # of pairs a * step + b
        self._whole: dict[int, bool] = {}
        self.step = max(self.id.values()) + 1

    def _spine(self, token: int, side: int, kept: dict) -> list:
        """(symbol, rank of the merge that ends it) at one edge of a token, the token first."""
        found = kept.get(token)
        if found is None:
            found, t, ends = [], token, NEVER
            while True:
                found.append((t, ends))
                if t not in self.halves:
                    break
                ends, t = self.halves[t][2], self.halves[t][side]
            kept[token] = found
        return found

    def _joined(self, a: int, b: int, before: int) -> bool:
        """Whether a merge ranked below ``before`` joins symbols across the boundary of two tokens."""
        rank = self.rank.get
        for x, x_ends in self._spine(a, 1, self._right):
            for y, y_ends in self._spine(b, 0, self._left):
                r = rank((x, y))
                # of equal ranks the left one is merged first
                if r is not None and r < before and r < x_ends and r <= y_ends:
                    return True
        return False

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their text."""
        if len(self.verdicts) >= PAIR_ROWS:
            self.verdicts.clear()
        found = self.verdicts[a * self.step + b] = not self._joined(a, b, NEVER)
        return found

    def whole(self, token: int) -> bool:
        """Whether a token is the encoding of its own text."""
        found = self._whole.get(token)
        if found is None:
            a, b, r = self.halves.get(token, (None, None, None))
            found = self._whole[token] = a is None or (self.whole(a) and self.whole(b) and not self._joined(a, b, r))
        return found


class Trie:
    """Last-token states along the path of a depth-first traversal."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.whole = {s: t for s, t in tokens.id.items() if tokens.whole(t)}
        self.lengths = {t: len(s) for s, t in tokens.id.items()}
        self.nodes = 0

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words, in the order of the trie."""
        known, lengths, longest, step = self.whole.get, self.lengths, self.tokens.longest, self.tokens.step
        apart, verdict = self.tokens.apart, self.tokens.verdicts.get
        path, states = "", []
        for word in sorted(words):
            shared = len(states)
            if not word.startswith(path):
                shared = next(i for i, (a, b) in enumerate(zip(path, word + "\0")) if a != b)
                del states[shared:]
            path, size = word, len(word)
            for end in range(shared + 1, size + 1):
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    token = known(word[start:end])
                    if token is None:
                        continue
                    if start:
                        before = states[start - 1]
                        fits = verdict(before * step + token)
                        if not (apart(before, token) if fits is None else fits):
                            continue
                    states.append(token)
                    break
                else:
                    raise ValueError(f"no token of the vocabulary ends at {word[:end]!r}")
            self.nodes += size - shared
            ids, at = [], size
            while at:
                token = states[at - 1]
                ids.append(token)
                at -= lengths[token]
            ids.reverse()
            yield word, ids


#: A piece ends before blanks; other white space stays inside.
_CUT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Blanks beside white space, which a cut before the blanks would part.
_MIXED = re.compile(r"[^\S \n][ \n]")


def cut(text: str) -> list[str]:
    """Pieces whose words do not depend on what is beside them: blanks and what follows them."""
    if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[-1:].isspace():
        parts = _CUT.findall(text)
    else:  # single blanks; "\n" keeps its place, a space is put back
        first, *more = text.replace("\n", " \n").split(" ")
        parts = [first, *[x if x[0] == "\n" else " " + x for x in more]]
    if not _MIXED.search(text):
        return parts
    out: list[str] = []
    for part in parts:
        if out and out[-1][-1:].isspace():
            out[-1] += part
        else:
            out.append(part)
    return out


#: The words of a plain byte-level pre-tokenizer (fixed), for text below U+0250, where all Unicode versions agree.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_OLD = "\u0250"


class Codec:
    """Ids and surfaces of pieces, by the trie of their words."""

    def __init__(self, path: str, rows: int = TABLE_ROWS):
        spec, library = json.load(open(path, encoding="utf-8")), Tokenizer.from_file(path)
        pre = spec["pre_tokenizer"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(
                t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        self.byte = {c: b for b, c in enumerate(byte_characters())}
        self.tokens, self.pre = Tokens(spec["model"], self._raw), library.pre_tokenizer
        self.trie = Trie(self.tokens)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bytes = {t: s.encode("latin-1") for s, t in self.tokens.id.items()} | {t: s.encode() for s, t in self.added.items()}
        self.words: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}  # pieces that decode to something else
        self.table = PieceTable(self.fill, rows)

    def _raw(self, shown: str) -> str:
        """The bytes that printable characters stand for, one character per byte."""
        return bytes(map(self.byte.__getitem__, shown)).decode("latin-1")

    def words_of(self, pieces: list[str]) -> list[list[str]]:
        """The pre-tokenizer's words of every piece."""
        # a piece that begins with a blank and ends without one can stand beside others of its kind
        beside = [p[:1] in (" ", "\n") and p < _OLD and max(p) < _OLD and not p[-1].isspace() for p in pieces]
        made = iter(_WORDS.findall("".join([p for p, b in zip(pieces, beside) if b])))
        out = []
        for piece, own in zip(pieces, beside):
            if own:
                word = next(made)
                words, need = [word], len(piece) - len(word)
                while need:
                    words.append(next(made))
                    need -= len(words[-1])
            else:
                words = [self._raw(w).encode("latin-1").decode() for w, _ in self.pre.pre_tokenize_str(piece)]
            out.append(words)
        return out

    def fill(self, pieces: list[str]) -> list[bytes]:
        """Ids, as unsigned 32-bit numbers, of distinct pieces."""
        split = self.words_of(pieces)
        known = self.words
        new = {w.encode().decode("latin-1"): w for w in set().union(*split).difference(known)}
        strange = set()
        for node, ids in self.trie.encode(new):
            known[new[node]] = array("I", ids).tobytes()
            if self.decode_bytes(ids) != node.encode("latin-1"):
                strange.add(new[node])
        for piece, words in zip(pieces, split) if strange else ():
            if not strange.isdisjoint(words):
                self.odd[piece] = self.decode_bytes(memoryview(b"".join([known[w] for w in words])).cast("I"))
        out = [known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words]) for words in split]
        if len(known) > self.table.rows:
            self.words = {}
        elif new and max(map(len, new)) > TABLE_CHARS:
            self.words = {w: x for w, x in known.items() if len(w) <= TABLE_CHARS}
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes.get(i, b"") for i in ids])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids as unsigned 32-bit numbers, decoded text) of every text."""
        rows = []
        for text in texts:
            segments = self.split.split(text or "") if self.split else [text or ""]
            rows.append([part for segment in segments if segment for part in ((segment,) if segment in self.added else cut(segment))])
        ids = self.table.look_up(set().union(*rows).difference(self.added))
        ids.update((t, array("I", [i]).tobytes()) for t, i in self.added.items())
        for parts in rows:
            text = b"".join([self.odd.get(p) or p.encode() for p in parts]).decode("utf-8", "replace") if self.odd else "".join(parts)
            yield b"".join([ids[p] for p in parts]), text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a tokenizers file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _coder(path: str, outputs: tuple[str, ...]):
    make = {
        "n_tokens": lambda ids, text: len(ids) // 4,
        "ids": lambda ids, text: memoryview(ids).cast("I").tolist(),
        "decoded": lambda ids, text: text,
        "ids_sha256": lambda ids, text: hashlib.sha256(ids).hexdigest(),
        "decoded_sha256": lambda ids, text: hashlib.sha256(text.encode()).hexdigest(),
    }
    kinds = {"bigint": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in chunks(batches, "x", BATCH_BYTES):
            rows: list[list] = [[] for _ in outputs]
            for ids, text in own.encode(batch.column(1).to_pylist()):
                for name, column in zip(outputs, rows):
                    column.append(make[name](ids, text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=kinds[OUTPUTS[n]]) for n, c in zip(outputs, rows))], names=["doc_id", *outputs])

    return code


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and the chosen OUTPUTS of every text; ``path`` is a tokenizers file on each executor."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("x"))
    kinds = ", ".join(f"{n} {OUTPUTS[n]}" for n in outputs)
    return rows.mapInArrow(_coder(path, tuple(outputs)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kinds}")


def decode(rows: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """doc_id and the text of every id list (null: empty); ids outside the vocabulary are left out."""
    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode_bytes(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "decoded"])

    found = rows.select(F.col(key).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return found.mapInArrow(back, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, decoded string")
