"""CSV records as expressions: quotes, cells and what a line leaves open.

A quote opens a cell only where a cell begins; inside such a cell two quotes stand for
one, and after its closing quote further text belongs to the cell. A quote in the middle
of an unquoted cell is text. A text is read from quote to quote, not by characters.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Where a reader stands: at the beginning of a cell, inside an unquoted one, inside a
# quoted one, or behind a quote that closes it or is the first of two.
_BEGIN, _TEXT, _QUOTED, _CLOSED = range(4)

# Marks put into a text while it is cut; a mark's own first character is escaped before.
_ESCAPE, _ESCAPED, _COMMA, _RETURN = "\x01", "\x01\x02", "\x01\x03", "\x01\x04"


def _after_quote(state: Column) -> Column:
    return (
        F.when(state == _BEGIN, _QUOTED).when(state == _TEXT, _TEXT).when(state == _QUOTED, _CLOSED).otherwise(_QUOTED)
    )


def _after_text(state: Column, text: Column) -> Column:
    """State behind a stretch of text without quotes."""
    return F.when((state == _QUOTED) | (text == ""), state).when(text.endswith(","), _BEGIN).otherwise(_TEXT)


def _stretches(text: Column) -> tuple[Column, Column]:
    """The text before the first quote, and the texts after each quote."""
    parts = F.split(text, '"', -1)
    return F.get(parts, 0), F.slice(parts, 2, F.size(parts))


def leaves_open(line: Column, begins_open: bool) -> Column:
    """Whether a quoted cell goes on behind the line, which begins outside or inside one."""
    start = _QUOTED if begins_open else _BEGIN
    first, rest = _stretches(line)
    state = F.aggregate(
        rest, _after_text(F.lit(start), first).cast("int"), lambda s, t: _after_text(_after_quote(s), t).cast("int")
    )
    return F.when(line.contains('"'), state == _QUOTED).otherwise(F.lit(begins_open))


def _marked(text: Column) -> Column:
    """Commas and carriage returns outside quoted cells as marks."""
    return F.replace(F.replace(text, F.lit(","), F.lit(_COMMA)), F.lit("\r"), F.lit(_RETURN))


def split_cells(record: Column) -> Column:
    """The cells of a whole record, as an array of texts.

    Carriage returns at its end are dropped; elsewhere they are an error outside quotes.
    """
    text = F.replace(record, F.lit(_ESCAPE), F.lit(_ESCAPED))
    first, rest = _stretches(text)

    def step(acc: Column, part: Column) -> Column:
        before = acc["state"]
        literal = F.when((before == _TEXT) | (before == _CLOSED), '"').otherwise("")
        state = _after_quote(before)
        said = F.concat(acc["out"], literal, F.when(state == _QUOTED, part).otherwise(_marked(part)))
        return F.struct(_after_text(state, part).cast("int").alias("state"), said.alias("out"))

    begin = F.struct(_after_text(F.lit(_BEGIN), first).cast("int").alias("state"), _marked(first).alias("out"))
    quoted = F.aggregate(rest, begin, step, lambda acc: acc["out"])
    marked = F.when(text.contains('"'), quoted).otherwise(_marked(text))
    ended = F.when(marked.endswith(_RETURN), F.regexp_replace(marked, f"({_RETURN})+$", "")).otherwise(marked)

    def cut(out: Column) -> Column:
        cells = F.split(out, _COMMA, -1)
        plain = F.transform(cells, lambda c: F.replace(c, F.lit(_ESCAPED), F.lit(_ESCAPE)))
        stray = F.raise_error(F.lit("invalid CSV: a carriage return outside quotes")).cast("array<string>")
        return F.when(out.contains(_RETURN), stray).when(out.contains(_ESCAPED), plain).otherwise(cells)

    return F.get(F.transform(F.array(ended), cut), 0)
