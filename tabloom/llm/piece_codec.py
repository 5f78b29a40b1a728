"""SentencePiece encoding and decoding with a table of distinct chunks.

In a model whose pieces never hold a word character before a whitespace marker, merges
cannot cross into the next marked word.  A text is therefore cut into chunks (a run of
markers and the word after it), each distinct chunk is segmented and decoded once by the
sentencepiece library, and the ids and surfaces are joined back by position.

The table lives in the Python worker, serves all batches and tasks that the worker gets, and
is emptied when it passes ``TABLE_ROWS`` chunks, which only costs repeated work.  One global
table would have to shuffle every word occurrence to join the ids back; here nothing moves.
The model is a file at the same path on every executor.

Defined cases: null and empty texts have no ids and decode to the empty text; blanks at
either end and runs of blanks keep their exact ids; a literal marker character is a blank to
the model, so it decodes to a space; a chunk of any length is encoded whole.  Each row gets
its result, whatever repeats.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .words import chunks

MARK = "▁"
#: Distinct chunks a worker keeps, and the longest it keeps.
TABLE_ROWS, TABLE_CHARS = 400_000, 64
#: Result columns and their types.
OUTPUTS = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


class Chunks(dict):
    """chunk -> its ids as text, filled on first use; ``odd`` has surfaces unlike the chunk."""

    def __init__(self, model: str):
        super().__init__()
        self.model, self.odd = sentencepiece.SentencePieceProcessor(model_file=model), {}
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces) or self.model.encode(f"a  {MARK}a", out_type=str)[:1] != [f"{MARK}a"]:
            raise ValueError(f"{model}: pieces cross whitespace markers, or the model adds no marker")

    def __missing__(self, chunk: str) -> str:
        # encoding adds one marker in front, which is the one that the chunk leaves out
        ids = self.model.encode(chunk) if chunk else [self.model.piece_to_id(MARK)]
        if (surface := self.model.decode(ids)) != chunk:
            self.odd[chunk] = surface
        out = ",".join(map(str, ids))
        if len(chunk) <= TABLE_CHARS:
            self[chunk] = out
        return out

    def trim(self) -> None:
        if len(self) > TABLE_ROWS:
            self.clear()
            self.odd.clear()


def cut(text: str) -> list[str]:
    """Chunks of a text, each without its first marker: a word with the blanks before it."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, blanks = [], 0
    for part in parts:
        if part:
            out.append(" " * blanks + part)
            blanks = 0
        else:
            blanks += 1
    if blanks:  # markers without a word
        out.append(" " * (blanks - 1))
    return out


_tables: dict[str, Chunks] = {}


def _coder(model: str, outputs: tuple[str, ...]):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _tables:
            _tables[model] = Chunks(model)
        table = _tables[model]
        surface = lambda parts: " ".join([table.odd.get(c, c) for c in parts])
        make = {
            "n_tokens": lambda parts, ids: ids.count(",") + 1 if ids else 0,
            "ids": lambda parts, ids: list(map(int, ids.split(","))) if ids else [],
            "decoded": lambda parts, ids: surface(parts),
            "ids_sha256": lambda parts, ids: hashlib.sha256(ids.encode()).hexdigest(),
            "decoded_sha256": lambda parts, ids: hashlib.sha256(surface(parts).encode()).hexdigest(),
        }
        kinds = {"bigint": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
        for batch in chunks(batches, "x"):
            rows: list[list] = [[] for _ in outputs]
            for text in batch.column(1).to_pylist():
                parts = cut(text or "")
                ids = ",".join([table[c] for c in parts])
                for name, col in zip(outputs, rows):
                    col.append(make[name](parts, ids))
            table.trim()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=kinds[OUTPUTS[n]]) for n, c in zip(outputs, rows))], names=["doc_id", *outputs])

    return code


def encode(docs: DataFrame, model: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and the chosen OUTPUTS of every text; one narrow pass, no shuffle."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("x"))
    kinds = ", ".join(f"{n} {OUTPUTS[n]}" for n in outputs)
    return rows.mapInArrow(_coder(model, tuple(outputs)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kinds}")


def decode(rows: DataFrame, model: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """doc_id and the text of every id list (null: empty), by the library's decode."""
    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([library.decode(x or []) for x in batch.column(1).to_pylist()], type=pa.string())], names=["doc_id", "decoded"])

    found = rows.select(F.col(key).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return found.mapInArrow(back, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, decoded string")
