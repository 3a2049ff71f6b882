"""Fill-in-middle by block rotation inside one buffer.

The cuts of all texts of a batch come from one scan of its bytes. Sentinels are inserted
into a bytearray, so that it holds prefix, middle and suffix in the order of the text, each
behind its sentinel. A block is rotated by three reversals: both halves in place, then the
whole. Reading back finds the sentinels, rotates the other way and takes them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from flowsift.llm.tokens import in_steps

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def rotate(buffer: bytearray, low: int, middle: int, high: int) -> None:
    """Exchange buffer[low:middle] and buffer[middle:high] by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((low, middle), (middle, high), (low, high)):
        half = (b - a) // 2
        kept = view[a : a + half].copy()
        view[a : a + half] = view[b - half : b][::-1]
        view[b - half : b] = kept[::-1]


def transform(text: bytes, form: str, first: int, second: int) -> bytearray:
    """The text with its middle text[first:second] last ("psm" or "spm"), or as it is ("plain")."""
    out = bytearray(text)
    if form == "plain":
        return out
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):  # from the right, so that places hold
        out[at:at] = mark
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(out, middle if form == "psm" else 0, suffix, len(out))
    return out


def restore(output: bytes, form: str) -> bytearray:
    """The text of a transformed one: the rotation undone, the sentinels taken out.

    No text that is transformed holds a sentinel, and none can arise where a text and a
    sentinel meet, as all begin with the one '<' they hold.
    """
    out = bytearray(output)
    if form == "plain":
        return out
    suffix = out.index(SUFFIX)
    if form == "psm":  # prefix, suffix, middle: the last two change places
        middle = out.index(MIDDLE)
        rotate(out, suffix, middle, len(out))
    else:  # suffix, then prefix and middle
        rotate(out, suffix, out.index(PREFIX), len(out))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = out.index(mark)
        del out[at : at + len(mark)]
    return out


def _starts(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of the texts, their bytes, where characters begin, where units begin.

    A unit is a run of ASCII letters or one other character.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    char = (data & 0xC0) != 0x80
    unit = char.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    begins = offsets[:-1][np.diff(offsets) > 0]
    unit[begins] = True
    return offsets, data, np.flatnonzero(char), np.flatnonzero(unit)


def _draws(doc_id: Column, seed: str) -> list[Column]:
    """h1 to h4: the first 8-digit groups of sha256("<seed>:<doc_id>") as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str, text_col: str, seed: str = "1", transformed: int = 90, suffix_first: int = 20
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every text with its middle moved to the end.

    Cuts lie between units (runs of ASCII letters, or one other character); h1 and h2 choose
    them, h3 leaves all but `transformed` percent plain, h4 makes `suffix_first` percent of
    the others begin with the suffix. Empty texts and texts that hold a sentinel are plain,
    with null prefix_chars and middle_chars. A null text is empty; a null doc_id draws as
    the empty string; repeated rows keep rows of their own with equal results; other columns
    play no part; no documents, no rows. A document is one row and must fit a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in (s for b in batches for s in in_steps(b, 1)):
            texts = step.column(1).cast(pa.large_string())
            h = [step.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]
            offsets, data, chars, units = _starts(texts)
            low, high = np.searchsorted(units, offsets[:-1]), np.searchsorted(units, offsets[1:])
            n = high - low
            cuts = np.sort(np.stack((h[0] % (n + 1), h[1] % (n + 1))), axis=0)
            bounds = np.append(units, offsets[-1])
            places = np.where(cuts == n, offsets[1:], bounds[np.minimum(low + cuts, len(units))])
            marked = np.zeros(len(n), bool)
            for mark in (PREFIX, SUFFIX, MIDDLE):
                marked |= pc.match_substring(texts, mark.decode()).to_numpy(zero_copy_only=False)
            plain = (n == 0) | marked | (h[2] % 100 >= transformed)
            form = np.where(plain, "plain", np.where(h[3] % 100 < suffix_first, "spm", "psm"))
            at = np.searchsorted(chars, np.vstack((offsets[None, :-1], places)))
            first, second = places - offsets[:-1]
            whole = memoryview(data)
            out = [
                transform(whole[a:b], f, p, m).decode("utf-8", "surrogateescape")
                for a, b, f, p, m in zip(offsets[:-1].tolist(), offsets[1:].tolist(), form.tolist(), first.tolist(), second.tolist())
            ]
            counts = [pa.array(at[i + 1] - at[i], pa.int64(), mask=plain) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [step.column(0), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *counts, pa.array(out, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    doc_id = F.col(f"`{id_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    return docs.select(doc_id.alias("doc_id"), text, *_draws(doc_id, seed)).mapInArrow(run, _OUT)


def restore_texts(transformed: DataFrame) -> DataFrame:
    """`transformed` (doc_id, form, output and any others) with `restored`, from form and output alone.

    A null form or output restores to null.
    """
    picked = transformed.select(*[c for c in transformed.columns if c not in ("form", "output")], "form", "output")
    names, width = [*picked.columns, "restored"], len(picked.columns)
    schema = picked.schema.simpleString()[len("struct<") : -1] + ",restored:string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in (s for b in batches for s in in_steps(b, width - 1)):
            forms, outputs = step.column(width - 2).to_pylist(), step.column(width - 1).cast(pa.binary()).to_pylist()
            texts = [None if f is None or o is None else restore(o, f).decode() for f, o in zip(forms, outputs)]
            yield pa.RecordBatch.from_arrays([*step.columns, pa.array(texts, pa.string())], names=names)

    return picked.mapInArrow(run, schema)
