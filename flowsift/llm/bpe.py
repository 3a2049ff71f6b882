"""Byte-level BPE as a monoid: encode halves, join neighbours at a re-encoded boundary.

The pre-tokenizer always cuts between a character that is no white space and a white
space after it, whatever stands around them: no alternative of the pattern crosses that
place, and none looks beyond it in a way that changes an earlier match. Such a place is
a stable cut. To join two encoded halves, a window around their boundary grows until
it begins and ends at stable cuts (or at the ends of the text); only the window is
encoded anew, and the tokens outside it are those of the joined text.
Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsift.llm.tokens import in_steps

#: Halves of at most this many characters are encoded directly.
LEAF = 4096
#: The first window reaches this many characters to either side.
REACH = 64
#: Python's white space that the pattern's \s does not match.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"


@functools.lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str):
    """(encoding, bytes by rank) of a rank file, once per process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table


def _space(c: str) -> bool:
    return c.isspace() and c not in _NOT_SPACE


def _cut_before(text: str, low: int, high: int) -> int:
    """The last stable cut in (low, high), or -1."""
    for i in range(high - 1, low, -1):
        if _space(text[i]) and not _space(text[i - 1]):
            return i
    return -1


def _cut_after(text: str, low: int, high: int) -> int:
    """The first stable cut in (low, high), or -1."""
    for i in range(low + 1, high):
        if _space(text[i]) and not _space(text[i - 1]):
            return i
    return -1


def _window(text: str, low: int, middle: int, high: int, reach: int) -> tuple[int, int]:
    """Where the window around `middle` begins and ends, inside [low, high]."""
    begin, step = -1, reach
    while begin < 0:
        edge = max(low, middle - step)
        begin = low if (found := _cut_before(text, edge, middle)) < 0 and edge == low else found
        step *= 2
    end, step = -1, reach
    while end < 0:
        edge = min(high, middle + step)
        end = high if (found := _cut_after(text, middle, edge)) < 0 and edge == high else found
        step *= 2
    return begin, end


def encode_tree(text: str, encode, leaf: int = LEAF, reach: int = REACH) -> list[int]:
    """The ids of `text`; encode(part) gives those of a part alone."""

    def build(low: int, high: int) -> list[int]:
        if high - low <= leaf:
            return encode(text[low:high])
        middle = (low + high) // 2
        left, right = build(low, middle), build(middle, high)
        begin, end = _window(text, low, middle, high, reach)
        if begin == low and end == high:
            return encode(text[low:high])
        keep = len(left) - len(encode(text[begin:middle]))
        drop = len(encode(text[middle:end]))
        return left[:keep] + encode(text[begin:end]) + right[drop:]

    return build(0, len(text))


def decode_tree(ids: np.ndarray, table: list[bytes], leaf: int = LEAF) -> bytes:
    """The bytes of the ids, halves concatenated up the tree."""
    if len(ids) <= leaf:
        return b"".join([table[i] for i in ids.tolist()])
    middle = len(ids) // 2
    return decode_tree(ids[:middle], table, leaf) + decode_tree(ids[middle:], table, leaf)


def encode_batches(batches: Iterable[pa.RecordBatch], ranks_path: str, pattern: str, leaf: int = LEAF) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, ids) of batches of ids and texts, in steps bounded in bytes of text."""
    encoding, _ = load_encoding(ranks_path, pattern)
    for batch in (step for whole in batches for step in in_steps(whole, 1)):
        out = [
            np.array(encode_tree(t or "", encoding.encode_ordinary, leaf), "<u4").tobytes() for t in batch.column(1).to_pylist()
        ]
        sizes = pa.array([len(b) // 4 for b in out], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def decode_batches(batches: Iterable[pa.RecordBatch], ranks_path: str, pattern: str, leaf: int = LEAF) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, ids, decoded) of batches of the first three, in steps bounded in bytes of ids."""
    _, table = load_encoding(ranks_path, pattern)
    for batch in (step for whole in batches for step in in_steps(whole, 2)):
        out = [None if b is None else decode_tree(np.frombuffer(b, "<u4"), table, leaf) for b in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"]
        )


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def encode_documents(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit numbers, special tokens never used.

    A null or empty text has no ids. Null and repeated doc_ids keep rows of their own;
    other columns play no part. A document is one row and must fit a task.
    """

    def run(batches):
        return encode_batches(batches, ranks_path, pattern, leaf)

    return _picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the bytes that the ids stand for; null ids decode to null."""

    def run(batches):
        return decode_batches(batches, ranks_path, pattern, leaf)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded binary"
    )


def round_trip_documents(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """The rows of `decode_documents` behind `encode_documents`, by one Python worker for each task.

    The two one behind the other hold two workers for each task, with the vocabulary in both.
    """

    def run(batches):
        return decode_batches(encode_batches(batches, ranks_path, pattern, leaf), ranks_path, pattern, leaf)

    return _picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
