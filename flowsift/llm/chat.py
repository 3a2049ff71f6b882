"""Chat records of unlike layouts as one marked-up text with a loss mask.

A record is a JSON text. The nested field paths of a record (its variant schema without
scalar types) are hashed; the hash selects a declarative mapping that yields canonical
turns. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Turns:
    """Turns from an array of objects: where it lies, and its fields for role and text."""

    array: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Fixed:
    """Turns from named fields, in order; `optional` ones may be absent or null."""

    fields: tuple[tuple[str, str], ...]
    optional: tuple[str, ...] = ()


#: Layouts by name. Field names that public chat and instruction sets use.
LAYOUTS: dict[str, Turns | Fixed] = {
    "messages": Turns("messages", "role", "content"),
    "share": Turns("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    "prompt": Fixed((("user", "prompt"), ("assistant", "completion"))),
    "response": Fixed((("user", "prompt"), ("assistant", "response"))),
    "instruction": Fixed(
        (("system", "system"), ("user", "instruction"), ("assistant", "output")), optional=("system",)
    ),
    "question": Fixed((("user", "question"), ("assistant", "answer"))),
}
_SCALAR = r":\s*(?:STRING|BIGINT|INT|SMALLINT|TINYINT|BOOLEAN|DOUBLE|FLOAT|DECIMAL\(\d+,\s*\d+\)|DATE|TIMESTAMP|VOID)"


def _shape(node) -> str:
    """A schema text as schema_of_variant spells it, scalar types left out."""
    if isinstance(node, dict):
        return "OBJECT<" + ", ".join(f"{k}: {_shape(v)}" if v else k for k, v in sorted(node.items())) + ">"
    return f"ARRAY<{_shape(node[0])}>" if node and node[0] else "ARRAY<VOID>" if node else ""


def fingerprint_of(shape: str) -> str:
    return hashlib.md5(shape.encode()).hexdigest()


def fingerprints(layouts: dict[str, Turns | Fixed]) -> dict[str, str]:
    """Layout by fingerprint. Two layouts with the same paths are an error."""
    out: dict[str, str] = {}
    for name, spec in layouts.items():
        if isinstance(spec, Turns):
            shapes = [{spec.array: []}]
            shapes = [_shape({spec.array: [{spec.role: None, spec.text: None}]}), _shape({spec.array: [None, None]})]
        else:
            need = [f for _, f in spec.fields if f not in spec.optional]
            shapes = [
                _shape(dict.fromkeys([*need, *extra]))
                for n in range(len(spec.optional) + 1)
                for extra in itertools.combinations(spec.optional, n)
            ]
        for shape in shapes:
            if out.setdefault(fingerprint_of(shape), name) != name:
                raise ValueError(f"layouts {out[fingerprint_of(shape)]} and {name} have the same field paths")
    return out


def field_paths(record: Column) -> Column:
    """The record's nested field paths in one text; null if it is no JSON."""
    return F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), _SCALAR, "")


def _turns(variant: Column, spec: Turns | Fixed) -> Column:
    def empty(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    if isinstance(spec, Turns):
        items = F.try_variant_get(variant, f"$.{spec.array}", f"array<struct<`{spec.role}`:string,`{spec.text}`:string>>")

        def canonical(role: Column) -> Column:
            out = role
            for theirs, ours in spec.roles.items():
                out = F.when(role == theirs, F.lit(ours)).otherwise(out)
            return empty(out)

        return F.transform(
            items, lambda x: F.struct(canonical(x[spec.role]).alias("role"), empty(x[spec.text]).alias("text"))
        )
    parts = []
    for role, name in spec.fields:
        text = F.try_variant_get(variant, f"$.{name}", "string")
        turn = F.struct(F.lit(role).alias("role"), empty(text).alias("text"))
        parts.append(F.when(text.isNotNull(), F.array(turn)) if name in spec.optional else F.array(turn))
    return F.concat(*[F.coalesce(p, F.array().cast(_TURNS)) for p in parts])


def escape(text: Column) -> Column:
    """Control strings as ordinary text: one backslash more between `<` and `|`. Other text is unchanged."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """Undo `escape`."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def canonical_turns(records: DataFrame, record: str, layouts: dict[str, Turns | Fixed] | None = None) -> DataFrame:
    """`records` with `fingerprint`, `layout` and `turns` (array of role and text).

    The layout is found by the hash of the nested field paths. Null or malformed JSON and
    unknown layouts keep their row with a null layout and null turns. Null roles and
    texts become empty. Input columns of these three names are replaced.
    """
    layouts = LAYOUTS if layouts is None else layouts
    by_hash = fingerprints(layouts)
    kept = [F.col(f"`{c}`") for c in records.columns if c.lower() not in ("fingerprint", "layout", "turns")]
    text = F.col(f"`{record}`")
    hashed = F.md5(field_paths(text).cast("binary"))
    layout = F.element_at(F.create_map(*[F.lit(x) for pair in by_hash.items() for x in pair]), hashed)
    turns = F.lit(None).cast(_TURNS)
    for name, spec in layouts.items():
        turns = F.when(layout == name, _turns(F.try_parse_json(text), spec)).otherwise(turns)
    return records.select(*kept, hashed.alias("fingerprint"), layout.alias("layout"), turns.alias("turns"))


def render(turns: Column) -> Column:
    """Canonical turns as one text: start mark, role, line break, text, end mark, line break."""
    block = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, block), "")


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """Which spans of the rendered text are trained on: (start, length) in code points, (at, size) in bytes."""
    head = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))
    tail = len(END) + 1
    step = lambda t: F.struct(
        (t["role"] == role).alias("loss"),
        F.length(head(t)).alias("lead"),
        F.octet_length(head(t)).alias("lead_b"),
        F.length(escape(t["text"])).alias("n"),
        F.octet_length(escape(t["text"])).alias("n_b"),
    )
    state = "struct<at:bigint,at_b:bigint,spans:array<struct<start:bigint,length:bigint,at:bigint,size:bigint>>>"
    zero = F.expr(f"CAST(named_struct('at', 0L, 'at_b', 0L, 'spans', array()) AS {state})")

    def add(acc: Column, x: Column) -> Column:
        span = F.struct(
            (acc["at"] + x["lead"]).alias("start"),
            x["n"].cast("long").alias("length"),
            (acc["at_b"] + x["lead_b"]).alias("at"),
            x["n_b"].cast("long").alias("size"),
        )
        return F.struct(
            (acc["at"] + x["lead"] + x["n"] + tail).alias("at"),
            (acc["at_b"] + x["lead_b"] + x["n_b"] + tail).alias("at_b"),
            F.when(x["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(F.transform(turns, step), zero, add, lambda acc: acc["spans"])


def format_chat(records: DataFrame, record: str, layouts: dict[str, Turns | Fixed] | None = None) -> DataFrame:
    """`records` with `formatted` (text) and `loss_spans` beside the columns of canonical_turns.

    A record is one row and must fit a task; nothing larger is gathered. Records without
    a layout have null results, a record without turns has the empty text and no spans.
    """
    known = canonical_turns(records, record, layouts)
    kept = [F.col(f"`{c}`") for c in known.columns if c.lower() not in ("formatted", "loss_spans")]
    return known.select(*kept, render(F.col("turns")).alias("formatted"), loss_mask(F.col("turns")).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns back from a formatted text."""
    blocks = F.slice(F.split(formatted, re.escape(END + "\n")), 1, F.size(F.split(formatted, re.escape(END + "\n"))) - 1)

    def turn(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(START) + 1)), "\n", 1)
        return F.struct(
            _unescape_role(role).alias("role"),
            unescape(F.substr(block, F.length(role) + len(START) + 2)).alias("text"),
        )

    return F.transform(blocks, turn)


def read_loss(formatted_bytes: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; bytes in, so each span is one copy."""
    piece = lambda s: unescape(F.substring(formatted_bytes, (s["at"] + 1).cast("int"), s["size"].cast("int")).cast("string"))
    return F.array_join(F.transform(loss_spans, piece), "")
