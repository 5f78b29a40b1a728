"""Secret scans by dictionary-primed zstandard novelty.

Fixed base patterns (assignments, access ids, long hex strings) are always reported.  The
method adds strings that a sensitive word precedes and that do not compress: a candidate's
marginal cost is the size of its zstandard frame primed with a raw-content dictionary made of
common identifiers and the text around it, less the size of an empty frame.  Identifiers,
paths and repeated names cost few bytes there; random material costs about its own length.
A candidate is reported as ``novel`` when it costs ``NOVELTY`` of what random text of its own
alphabet and length costs (zstandard codes long random hex at half a byte a character).

Candidates end where the string ends, whatever its length.  A sensitive word reaches on from a
candidate to the next one that only a full stop or a line end parts from it, so that all lines
of a key block and all segments of a signed token are looked at.  Strings of letters alone or
without any letter are judged like others, but letters must also be as unlike identifiers as random ones.

One narrow pass over whole texts, no shuffle; work is linear in the text.

Defined cases: null and empty texts have no spans; each row gets its result, whatever
repeats; extra columns are ignored; offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .words import chunks

KINDS = ("assign", "access", "hex", "novel")
#: Fixed base patterns; the length limits stand in the loops where the result is the same.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
WORDS = ("passw", "secret", "token", "api")
#: Words that make the text after them sensitive, how far they reach, and the strings looked at.
SENSITIVE = re.compile(r"(?ai:passw|pwd|secret|token|api[_\x20-]?key|apikey|credential|bearer|authorization|private[_\x20-]?key|access[_\x20-]?key|signature)")
REACH = 48
STRING = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
#: What parts a candidate from the next in the same context, and the short last line of a key block.
ADJACENT = re.compile(r"""\.|(?:\\[rn]?)+|["'\\,;+\x20\t]*\r?\n[\x20\t"'>#*+]*""")
TAIL = re.compile(r"""(?:\\[rn]|["'\\,;+\x20\t]*\r?\n[\x20\t"'>#*+]*)([A-Za-z0-9+/]{1,15}={0,2})(?:\\[rn]|["'\\,;+\x20\t]*\r?\n[\x20\t"'>#*+]*)-----END""")
#: Share of the cost of random text from which a string is novel, and context characters on each side.
NOVELTY, AROUND = 0.85, 400
IDENTIFIERS = (
    "access account address algorithm api application argument array auth authorization backend base64 bearer boolean branch "
    "buffer bucket cache certificate class client cluster code column commit config connection const container content context "
    "controller cookie count credential data database default delete deploy description development directory document domain "
    "email encoding endpoint environment error event example exception export false field file filter format function gateway "
    "global group handler hash header host identifier image import index input instance integer interface internal issuer json "
    "label language library license list local location login manager message metadata method model module name namespace network "
    "none null number object option output package parameter parent password path pattern permission pipeline policy port prefix "
    "private process production project properties protocol provider public query queue region registry release repository request "
    "resource response return role root schema script secret security select server service session settings signature source "
    "staging static status storage string subject system table target template tenant test text thread timeout timestamp title "
    "token transaction true type undefined update upload user username utils value variable vendor version visibility volume web worker"
)
_writer = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
_empty = len(zstandard.ZstdCompressor(**_writer).compress(b""))


#: The usual encodings, the smallest first; a string's own alphabet is the first that has all its characters.
ALPHABETS = tuple(sorted({"".join(sorted(set(x))) for x in (
    string.digits, string.digits + "abcdef", string.digits + "ABCDEF", string.ascii_lowercase, string.ascii_uppercase,
    string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase,
    string.ascii_letters, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/",
    string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits + "+/_-")}, key=lambda x: (len(x), x)))


@lru_cache(maxsize=1 << 16)
def _random_cost(alphabet: str, length: int) -> float:
    return novelty("".join(random.Random(length).choices(alphabet, k=length)), "")


def random_cost(text: str) -> float:
    """What :func:`novelty` gives random text of the same alphabet and length, 1.0 at most."""
    own = set(text) - {"="}
    alphabet = next(x for x in ALPHABETS if own.issubset(x))
    step = 1 << max(0, len(text).bit_length() - 8)  # the cost a byte hardly changes within a 128th of the length
    return min(1.0, _random_cost(alphabet, len(text) // step * step))


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes per byte of a string against identifiers and its surroundings."""
    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + " " + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data = candidate.encode()
    return (len(zstandard.ZstdCompressor(dict_data=primed, **_writer).compress(data)) - _empty) / len(data)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def _letters() -> dict[str, float]:
    """Bits of a letter after another in identifiers, by pair."""
    pairs, first = Counter(), Counter()
    for word in IDENTIFIERS.split():
        pairs.update(map("".join, zip(word, word[1:])))
        first.update(word[:-1])
    return {a + b: -math.log2((pairs[a + b] + 0.5) / (first[a] + 13)) for a in string.ascii_lowercase for b in string.ascii_lowercase}


_bits = _letters()


def unlike_names(value: str) -> bool:
    """Whether letters follow each other as in random text rather than as in identifiers."""
    low = value.lower()
    known = [_bits[pair] for pair in map("".join, zip(low, low[1:])) if pair in _bits]
    return bool(known) and sum(known) / len(known) >= math.log2(26)


def is_novel(value: str, around: str) -> bool:
    if not re.search("[A-Za-z0-9]", value) or not re.search("[0-9]", value) and not unlike_names(value):
        return False
    return novelty(value, around) >= NOVELTY * random_cost(value)


def novel_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Incompressible strings after sensitive words, outside the known spans."""
    out, until = [], 0
    if not SENSITIVE.search(text):
        return out
    taken = bytearray(len(text))
    for s, _, e in known:
        taken[s:e] = b"\1" * (e - s)
    runs = [m.span() for m in STRING.finditer(text)]
    ends = [e for _, e in runs]
    for word in SENSITIVE.finditer(text):
        at, reach = max(word.end(), until), word.end() + REACH
        for i in range(bisect_right(ends, at), len(runs)):
            s, e = runs[i]
            s = max(s, at)
            s += text[s - 1] == "\\" and text[s] in "rn"  # an escaped line end, as in JSON
            if s > reach and not ADJACENT.fullmatch(text, at, s):
                break
            if e - s < LEAST:
                continue
            at = until = e
            if taken.find(1, s, e) >= 0:
                continue
            if is_novel(text[s:e], text[max(0, s - AROUND): s] + text[e: e + AROUND]):
                out.append((s, 3, e))
                if (tail := TAIL.match(text, e)) and taken.find(1, *tail.span(1)) < 0:
                    out.append((tail.start(1), 3, tail.end(1)))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "x"):
        found = []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text) if text else []
            found.append([{"s": s, "kind": k, "e": e} for s, k, e in sorted(spans + (novel_spans(text, spans) if text else []))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, type=pa.list_(pa.struct([("s", pa.int32()), ("kind", pa.int32()), ("e", pa.int32())])))], names=["doc_id", "spans"])


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and ``spans`` (s, kind, e), by start and kind; ``KINDS`` names the kinds."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("x"))
    return rows.mapInArrow(_scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<s:int,kind:int,e:int>>")
