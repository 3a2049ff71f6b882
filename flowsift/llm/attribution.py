"""Token counts of sections: encode a document once, map token spans to sections.

Byte-level tokens cover the text without gaps, so the byte lengths of the ids give each
token's character span. Sections are spans too; both lists are sorted and meet in an
interval join by binary search. A token that crosses a section's boundary goes where the
rule says.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsift.llm.tokens import Words, encode_texts, in_steps, load_tokenizer, token_bytes

RULES = ("start", "end", "majority")
_SECTIONS = "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long"


def line_sections(text: str, data: bytes) -> np.ndarray:
    """Byte starts of a text's lines; a line break belongs to the line that it ends."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    starts = np.concatenate(([0], breaks))
    return starts[starts < max(len(data), 1)]


def attribute(ends: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section.

    ends: byte ends of the tokens; starts: byte starts of the sections, the first 0.
    start: a token belongs to the section of its first byte; end: of its last byte;
    majority: of most of its bytes, the earlier one if equal.
    """
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    if rule == "start":
        owner = first
    elif rule == "end":
        owner = last
    else:
        owner = first.copy()
        for i in np.flatnonzero(first != last):
            edges = np.clip(np.append(starts[first[i] : last[i] + 1], ends[i]), begins[i], ends[i])
            owner[i] += int(np.argmax(np.diff(edges)))
    crossing = owner[first != last]
    return np.bincount(owner, minlength=len(starts)), np.bincount(crossing, minlength=len(starts))


def section_tokens(
    docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, rule: str = "start", sections=line_sections
) -> DataFrame:
    """One row per section: doc_id, section, start_char, end_char, n_tokens, n_crossing, doc_tokens.

    `sections(text, utf8)` gives the byte starts, the first 0. The n_tokens of a document
    add up to doc_tokens; n_crossing counts those that reach into another section. An empty
    or null text has one empty section with no token. Null and repeated doc_ids keep rows
    of their own. Other columns of `docs` play no part.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches):
        tokenizer = load_tokenizer(tokenizer_path)
        sizes, words = token_bytes(tokenizer), Words(tokenizer)
        for batch in (step for whole in batches for step in in_steps(whole, 1)):
            parts: list[list[np.ndarray]] = [[] for _ in range(7)]
            texts = batch.column(1).to_pylist()
            for row, (text, ids) in enumerate(zip(texts, encode_texts(words, batch.column(1)), strict=True)):
                data = (text or "").encode()
                ends = np.cumsum(sizes[ids])
                starts = sections(text or "", data)
                owned, crossing = attribute(ends, starts, rule)
                leads = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
                chars = np.concatenate(([0], np.cumsum(leads)))[np.append(starts, len(data))]
                k = len(starts)
                for part, value in zip(
                    parts, (np.full(k, row), np.arange(k), chars[:-1], chars[1:], owned, crossing, np.full(k, len(ids))), strict=True
                ):
                    part.append(value)
            joined = [np.concatenate(p).astype(np.int64) if p else np.empty(0, np.int64) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(joined[0])), *map(pa.array, joined[1:])],
                names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"],
            )

    picked = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    return picked.mapInArrow(count, _SECTIONS)
