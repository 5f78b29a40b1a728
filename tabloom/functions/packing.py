"""Recursive separator splitting with greedy packing, as one column expression.

A text is split at a separator, which stays at the start of the piece behind it.  Pieces
shorter than ``size`` are packed greedily into chunks; a new chunk starts with the pieces
that end the last one, up to ``overlap`` characters.  A longer piece ends the chunk before
it and is split at the next separator, at last by characters.

The packing is a fold over the lengths of the pieces: it carries the first piece and the
length of the open chunk and gives ranges of pieces; their texts are joined once, at the
end.  What a new chunk carries over is looked for among the last ``overlap`` pieces only, so
the work grows with the text (and one pointer per earlier chunk when a chunk is added).
Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Separators in the order in which they are tried (fixed values).
SEPARATORS = ("\n\n", "\n", " ")
# White space taken off both ends of a chunk (fixed values).
WHITE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
         "\u2028\u2029\u202f\u205f\u3000")
_RANGES = "array<struct<first:int,end:int,deep:boolean>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _range(first: Column, end: Column, deep: bool) -> Column:
    return F.struct(first.alias("first"), end.alias("end"), F.lit(deep).alias("deep"))


def _state(at: Column, first: Column, total: Column, out: Column) -> Column:
    return F.struct(at.alias("at"), first.alias("first"), total.alias("total"), out.alias("out"))


def _ranges(lengths: Column, size: int, overlap: int) -> Column:
    """Ranges of pieces in order: chunks, and single pieces that are to be split further (``deep``)."""

    def carried(s: Column, n: Column) -> Column:
        """Pieces and characters at the end of the open chunk that the next one starts with."""
        many = F.least(F.lit(overlap), s["at"] - s["first"])
        room = F.least(F.lit(overlap), F.lit(size) - n)
        start = F.struct(F.lit(0).alias("pieces"), F.lit(0).alias("chars"), F.lit(True).alias("more"))
        return F.aggregate(F.reverse(F.slice(lengths, s["at"] - many + 1, many)), start, lambda c, x: F.when(
            c["more"] & (c["chars"] + x <= room),
            F.struct((c["pieces"] + 1).alias("pieces"), (c["chars"] + x).alias("chars"), F.lit(True).alias("more"))).otherwise(
            F.struct(c["pieces"].alias("pieces"), c["chars"].alias("chars"), F.lit(False).alias("more"))))

    def step(s: Column, n: Column) -> Column:
        at, first, total, out = s["at"], s["first"], s["total"], s["out"]
        own = F.array(_range(at, at + 1, True))
        return F.when(n >= size, _state(at + 1, at + 1, F.lit(0), F.concat(out, F.when(
            first < at, F.concat(F.array(_range(first, at, False)), own)).otherwise(own)))).when(
            (total + n > size) & (first < at), _let(carried(s, n), lambda c: _state(
                at + 1, at - c["pieces"], c["chars"] + n, F.concat(out, F.array(_range(first, at, False)))))).otherwise(
            _state(at + 1, first, total + n, out))

    zero = _state(F.lit(0), F.lit(0), F.lit(0), F.array().cast(_RANGES))
    return F.aggregate(lengths, zero, step, lambda s: F.when(
        s["first"] < s["at"], F.concat(s["out"], F.array(_range(s["first"], s["at"], False)))).otherwise(s["out"]))


def _by_characters(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each starting ``overlap`` before the end of the last."""
    step = size - min(overlap, size - 1)
    windows = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")
    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), lambda blocks: F.transform(
        F.sequence(F.lit(0), windows),
        lambda k: F.substring(F.array_join(F.slice(blocks, k + 1, F.lit(-(-size // step))), ""), 1, size)))


def _split(text: Column, size: int, overlap: int, separators: tuple[str, ...]) -> Column:
    if not separators:
        return _by_characters(text, size, overlap)
    sep, rest = separators[0], separators[1:]
    pieces = F.filter(F.transform(F.split(text, sep, -1), lambda x, j: F.when(j > 0, F.concat(F.lit(sep), x)).otherwise(x)),
                      lambda x: x != "")
    return _let(pieces, lambda p: _let(F.transform(p, F.length), lambda lengths: F.flatten(F.transform(
        _ranges(lengths, size, overlap), lambda r: F.when(r["deep"], _split(p[r["first"]], size, overlap, rest)).otherwise(
            F.array(F.array_join(F.slice(p, r["first"] + 1, r["end"] - r["first"]), "")))))))


def packed_chunks(text: Column, size: int, overlap: int) -> Column:
    """The chunks of a text in order, without white space around them; blank ones are left out; null: null."""
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    return F.filter(F.transform(_split(text, size, overlap, SEPARATORS), lambda x: F.trim(x, F.lit(WHITE))), lambda x: x != "")
