"""Chat formatting by schema fingerprints.

A record's fingerprint is the SHA-256 of the sorted nested field paths (``messages[].role``,
``instruction``, ...) it holds of those that any layout knows; a path below an array is there when
one of its elements has it.  Each distinct fingerprint is resolved once, to the declarative layout that
says where the turns are, which fields lead them (a system prompt beside a list) and how role names map
to the canonical ones; the layout's name is joined back by fingerprint.  A layout fits when the record
has all its paths and no known text path that it does not read, so no turn is lost by a wrong choice;
of those that fit, lists come first, then the layout with the most paths.  A table has one fingerprint,
from its schema; JSON records have one each, so one column may mix layouts.  All layouts end in
canonical turns: (conv_id, turn, role, text).

The template writes each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and
texts every ``<`` that backslashes and a ``|`` follow gets one more backslash, so neither
marker can occur there and removing one gives the text back.  The loss mask is the code-point
range of an assistant's text.  Formatting is narrow: one row per turn, nothing is collected.
Only :func:`read_back` orders turns; it streams each conversation through a running digest,
whose memory does not grow with the conversation.

Defined cases: null role and text are empty; turns are ordered by turn (null first), then by their
formatted piece, so repeated turns stay, in a fixed order; a record whose fingerprint no layout fits
(none of its paths, or the texts of two layouts at once), or that is not JSON, yields one turn with
role null and the record as text, which callers can filter; fields that no layout knows are not turns;
a leading field that is null gives no turn; a text given as a list of parts is the parts' texts joined,
a part without a text as its JSON; an empty list of turns fits its layout and yields its leading
turns, or one row with turn, role and text null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from tabloom.plans.sizing import broadcast_if_bounded

from .exprs import let

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns: fields of given roles, an array with role and text fields, or one turn a row.

    ``lead`` names fields that may stand beside them and come first.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""
    lead: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> tuple[str, ...]:
        """Paths that a record of the layout must have."""
        if self.turn:
            return (self.turn, self.role, self.text)
        return tuple(p for _, p in self.fields) or (f"{self.array}[].{self.role}", f"{self.array}[].{self.text}")

    @property
    def reads(self) -> tuple[str, ...]:
        return self.paths + tuple(p for _, p in self.lead)


ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
SYSTEM = (("system", "system"),)
LISTS = (("messages", "role", "content"), ("conversations", "from", "value"), ("dialog", "speaker", "text"))
LAYOUTS = (
    *(Layout(array, array=array, role=role, text=text, lead=(*SYSTEM, ("user", "prompt")), roles=ROLES) for array, role, text in LISTS),
    *(Layout(f"data.{array}", array=f"data.{array}", role=role, text=text, lead=(*SYSTEM, ("system", "data.system")), roles=ROLES)
      for array, role, text in LISTS),
    Layout("instruction", (("user", "instruction"), ("assistant", "output")), lead=SYSTEM),
    Layout("instruction_input", (("system", "instruction"), ("user", "input"), ("assistant", "output")), lead=SYSTEM),
    Layout("prompt_completion", (("user", "prompt"), ("assistant", "completion")), lead=SYSTEM),
    Layout("prompt_response", (("user", "prompt"), ("assistant", "response")), lead=SYSTEM),
    Layout("question_answer", (("user", "question"), ("assistant", "answer")), lead=SYSTEM),
    Layout("turn_rows", role="role", text="text", turn="turn"),
)
#: Lists of turns first, then the layouts with the most fields.
BY_FIT = sorted(LAYOUTS, key=lambda layout: (not layout.array, -len(layout.paths)))
#: Paths of a fingerprint.
KNOWN = sorted({p for layout in LAYOUTS for p in layout.reads})
#: Of these, paths of whole texts: a layout that fits reads all that a record has.
TEXTS = sorted({p for layout in LAYOUTS if not layout.turn for p in layout.reads})


def schema_paths(schema: StructType, prefix: str = "") -> list[str]:
    """Nested field paths of a table; ``[]`` marks array elements."""
    out = []
    for f in schema:
        path, kind = prefix + f.name, f.dataType
        while isinstance(kind, ArrayType):
            path, kind = path + "[]", kind.elementType
        out += schema_paths(kind, path + ".") if isinstance(kind, StructType) else [path]
    return out


def known_paths(paths: list[str]) -> list[str]:
    """The known ones of a table's paths, sorted; a text may itself be nested (parts of a message)."""
    return [k for k in KNOWN if any(p == k or p.startswith((k + "[]", k + ".")) for p in paths)]


def fingerprint(known: list[str]) -> str:
    return hashlib.sha256("\n".join(known).encode()).hexdigest()


def resolve(prints: DataFrame) -> DataFrame:
    """(fingerprint, layout) of distinct (fingerprint, known): the first layout of ``BY_FIT`` that fits, or null."""
    def fits(layout: Layout) -> Column:
        spare = [p for p in TEXTS if p not in layout.reads]
        return (F.size(F.array_except(F.array(*map(F.lit, layout.paths)), "known")) == 0) & ~F.arrays_overlap("known", F.array(*map(F.lit, spare)))

    first = F.coalesce(*(F.when(fits(layout), F.lit(layout.name)) for layout in BY_FIT))
    return prints.select("fingerprint", first.alias("layout"))


def _as_text(value: Column) -> Column:
    """A text, or the texts of a list of parts, joined."""
    def part(x: Column) -> Column:
        return F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$", "string"), F.lit(""))

    def read(x: Column) -> Column:
        return let(F.try_variant_get(x, "$", "array<variant>"), lambda parts: F.when(
            parts.isNotNull(), F.array_join(F.transform(parts, part), "")).otherwise(F.try_variant_get(x, "$", "string")))

    return let(value, read)


def _turns(layout: Layout) -> Column:
    """Array of (turn, role, text) of the record ``v``; turn is null where the place in the array numbers it."""
    def at(path: str) -> Column:
        return _as_text(F.try_variant_get("v", f"$.{path}", "variant"))

    def one(role: Column, text: Column, turn: Column | None = None) -> Column:
        return F.struct((F.lit(None) if turn is None else turn).cast("bigint").alias("turn"), role.cast("string").alias("role"), text.alias("text"))

    if layout.turn:
        get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
        return F.array(one(get(layout.role, "string"), at(layout.text), get(layout.turn, "bigint")))
    lead = F.filter(F.array(*(one(F.lit(role), at(path)) for role, path in layout.lead)), lambda t: t["text"].isNotNull())
    if layout.fields:
        return F.concat(lead, F.array(*(one(F.lit(role), at(path)) for role, path in layout.fields)))
    names = F.create_map(*(F.lit(x) for pair in layout.roles.items() for x in pair)) if layout.roles else None
    rename = (lambda r: F.coalesce(F.try_element_at(names, r), r)) if layout.roles else (lambda r: r)
    items = F.try_variant_get("v", f"$.{layout.array}", "array<variant>")
    return F.concat(lead, F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda m: one(
        rename(F.try_variant_get(m, f"$.{layout.role}", "string")), _as_text(F.try_variant_get(m, f"$.{layout.text}", "variant")))))


def _exploded(rows: DataFrame, turns: Column) -> DataFrame:
    return rows.select("conv_id", F.posexplode_outer(turns).alias("place", "t")).select(
        "conv_id", F.coalesce("t.turn", "place").cast("bigint").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def from_table(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Canonical turns of a typed table, by the fingerprint of its schema."""
    known = known_paths(schema_paths(df.schema))
    spark = df.sparkSession
    prints = spark.createDataFrame([(fingerprint(known), known)], "fingerprint string, known array<string>")
    name = resolve(prints).first()["layout"]
    if name is None:
        raise ValueError(f"no layout for the fields {schema_paths(df.schema)}")
    layout = next(x for x in LAYOUTS if x.name == name)
    if layout.turn:
        return df.select(F.col(conv_id).alias("conv_id"), F.col(layout.turn).cast("bigint").alias("turn"),
                         F.col(layout.role).alias("role"), F.col(layout.text).alias("text"))
    tops = sorted({re.split(r"[.\[]", p)[0] for p in layout.reads} & set(df.columns))
    v = F.to_variant_object(F.struct(*(F.col(f"`{c}`") for c in tops)))
    return _exploded(df.select(F.col(conv_id).alias("conv_id"), v.alias("v")), _turns(layout))


def from_json(df: DataFrame, record: str, conv_id: str = "conv_id") -> DataFrame:
    """Canonical turns of a column of JSON records of any mix of layouts."""
    def present(path: str) -> Column:
        array, inside, name = path.partition("[].")
        if not inside:
            return F.try_variant_get("v", f"$.{path}", "variant").isNotNull()
        return let(F.try_variant_get("v", f"$.{array}", "array<variant>"), lambda items: F.coalesce(
            (F.size(items) == 0) | F.exists(items, lambda m: F.try_variant_get(m, f"$.{name}", "variant").isNotNull()), F.lit(False)))

    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("raw"), F.try_parse_json(F.col(record)).alias("v"))
    rows = rows.withColumn("known", F.array_compact(F.array(*(F.when(present(p), F.lit(p)) for p in KNOWN))))
    rows = rows.withColumn("fingerprint", F.sha2(F.array_join("known", "\n"), 256))
    names = resolve(rows.select("fingerprint", "known").distinct())
    rows = rows.drop("known").join(broadcast_if_bounded(names), "fingerprint", "left")
    turns = F.array(F.struct(F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("raw").alias("text")))
    for layout in LAYOUTS:
        turns = F.when(F.col("layout") == layout.name, _turns(layout)).otherwise(turns)
    return _exploded(rows, turns)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, piece, loss_start, loss_end): a conversation's text is its pieces in order.

    The loss range is in code points of the piece, empty for other roles than assistant.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))

    def build(p: Column) -> Column:
        at = F.length(p["head"])
        return F.struct(F.concat(p["head"], p["body"], F.lit(END + "\n")).alias("piece"), at.cast("bigint").alias("loss_start"),
                        F.when(p["loss"], at + F.length(p["body"])).otherwise(at).cast("bigint").alias("loss_end"))

    parts = F.struct(F.concat(F.lit(START), escape(line), F.lit("\n")).alias("head"), escape(text).alias("body"), (role == "assistant").alias("loss"))
    return turns.select("conv_id", "turn", let(parts, build).alias("f")).select("conv_id", "turn", "f.*")


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a formatted piece."""
    head, _, body = piece[len(START): -len(END) - 1].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(body)


DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted pieces: turn count, digests of turns and of the loss text, lengths."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, turns, loss, counts = none, None, None, None

        def done() -> list:
            return [conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]]

        for batch in batches:
            out = []
            col = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end")]
            for key, piece, a, b in zip(*col):
                if key != conv:
                    if conv is not none:
                        out.append(done())
                    conv, turns, loss, counts = key, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                role, text = parse(piece)
                turns.update(f"{role}\n{text}\n".encode())
                masked = unescape(piece[a:b])
                loss.update(masked.encode())
                counts[0] += 1
                counts[1] += len(masked)
                counts[2] += len(piece)
            yield made(out)
        yield made([done()] if conv is not none else [])

    def made(rows: list) -> pa.RecordBatch:
        kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = formatted.schema["conv_id"].dataType
    key_type = to_arrow_type(kind)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    return ordered.mapInArrow(digest, f"conv_id {kind.simpleString()}, {DIGESTS}")
