"""Token ids of whole texts, encoded inside Arrow batches.

A text is cut before every single space that follows other than white space: there the
tokenizer's own pre-tokenizer always cuts, so each piece has the ids it has in the whole
text. A batch encodes each distinct piece once. Texts in which some white space stands
before a space are encoded whole.
"""

from __future__ import annotations

import array
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that the pre-tokenizer's \s matches, then a space.
_SPACES = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Texts above this many bytes in one step are encoded one after another, to bound memory.
STEP_BYTES = 4_000_000
#: Pieces in one call of the tokenizer, and bytes of words encoded as one text.
SLICE, JOIN_BYTES = 5_000, 64_000
#: Bytes of words and their ids that a task keeps between its steps.
KEEP_BYTES = 64_000_000


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a file, once per process; special tokens' strings are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encode(tokenizer, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and how many each has; encoded in slices, to bound memory."""
    flat, counts = array.array("I"), []
    for i in range(0, len(pieces), SLICE):
        for e in tokenizer.encode_batch_fast(pieces[i : i + SLICE], add_special_tokens=False):
            ids = e.ids
            counts.append(len(ids))
            flat.extend(ids)
    return np.array(flat, np.uint32), np.array(counts, np.int64)


class Words:
    """Ids of words with a space before each, those met first kept up to `keep_bytes`; common words come early.

    It lives as long as the task that makes it.
    """

    def __init__(self, tokenizer, keep_bytes: int = KEEP_BYTES):
        self.tokenizer, self.room = tokenizer, keep_bytes
        self.sizes = token_bytes(tokenizer)
        self.slots: dict[str, int] = {}
        self.flat, self.begins, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `_encode` of " " + word each, but joined: the tokenizer cuts before each space that follows other than white space.

        The ids are parted where the bytes they stand for reach a word's end. A word that ends
        in white space, or is empty, stands alone.
        """
        alone = np.array([not w or w[-1].isspace() for w in words], bool)
        joined = [w for w, a in zip(words, alone.tolist()) if not a]
        ends = np.cumsum([len(w.encode()) + 1 for w in joined], dtype=np.int64)
        parts, counts, at = [], np.empty(len(words), np.int64), 0
        places = np.flatnonzero(~alone)
        while at < len(joined):
            base = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + JOIN_BYTES, "right")))
            text = " " + " ".join(joined[at:stop])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            reached = np.searchsorted(np.cumsum(self.sizes[ids]), ends[at:stop] - base) + 1
            counts[places[at:stop]] = np.diff(reached, prepend=0)
            parts.append(ids)
            at = stop
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        if not alone.any():
            return flat, counts
        more, counts[alone] = _encode(self.tokenizer, [" " + w for w, a in zip(words, alone.tolist()) if a])
        begins = np.empty(len(words), np.int64)
        begins[~alone] = np.cumsum(counts[~alone]) - counts[~alone]
        begins[alone] = np.cumsum(counts[alone]) - counts[alone] + len(flat)
        return _gather(np.concatenate((flat, more)), begins, counts), counts

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and where those of each word (distinct ones) begin and how many they are."""
        flat, begins, counts, passing = self.flat, self.begins, self.counts, {}
        new = [w for w in words if w not in self.slots]
        if new:
            more, n = self._encode_words(new)
            passing = dict(zip(new, range(len(counts), len(counts) + len(new)), strict=True))
            begins = np.concatenate((begins, np.cumsum(n) - n + len(flat)))
            flat, counts = np.concatenate((flat, more)), np.concatenate((counts, n))
            cost = sum(map(len, new)) + 4 * len(more) + 180 * len(new)  # keys, ids, and the entries themselves
            if cost <= self.room:
                self.room -= cost
                self.slots.update(passing)
                self.flat, self.begins, self.counts = flat, begins, counts
        known = self.slots.get
        slots = np.fromiter((passing[w] if (i := known(w)) is None else i for w in words), np.int64, len(words))
        return flat, begins[slots], counts[slots]


def _gather(flat: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs flat[begin : begin + count] joined."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(begins - ends + counts, counts)]


def in_steps(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most STEP_BYTES of the text column, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        floor = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, floor + STEP_BYTES, "right")))
        yield batch.slice(at, end - at)
        pa.default_memory_pool().release_unused()
        at = end


def encode_texts(words: Words, texts: pa.Array) -> list[np.ndarray]:
    """The ids (uint32) of every text; null is the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    out: list[np.ndarray] = []
    for step in in_steps(pa.RecordBatch.from_arrays([texts], names=["text"]), 0):
        flat, sizes = encode_step(words, step.column(0))
        ends = np.cumsum(sizes).tolist()
        out += [flat[b - n : b] for b, n in zip(ends, sizes.tolist(), strict=True)]
    return out


def encode_step(words: Words, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, each with `end_id` behind if given, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, _SPACES).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    coded = pc.list_flatten(lists).dictionary_encode()
    n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(n_words) - n_words
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.to_pylist()
    flat, word_begins, word_counts = words.look_up(distinct)
    # A text's first word has no space before it; it and whole texts are encoded apart.
    first = [distinct[c] for c in codes[starts]]
    apart, apart_counts = _encode(words.tokenizer, first + texts.filter(pa.array(odd)).to_pylist())
    apart_begins = np.cumsum(apart_counts) - apart_counts + len(flat)
    begins, counts = word_begins[codes], word_counts[codes]
    begins[starts], counts[starts] = apart_begins[: len(starts)], apart_counts[: len(starts)]
    # Each text as runs of the ids gathered so far: its words, or itself, and its end.
    closing = end_id is not None
    flat = np.concatenate((flat, apart, np.array([end_id] if closing else [], np.uint32)))
    runs = np.ones(len(odd), np.int64) + closing
    runs[~odd] = n_words + closing
    stop = np.cumsum(runs)
    run_begin, run_count = np.full(int(stop[-1]) if len(stop) else 0, len(flat) - 1), np.ones(int(stop[-1]) if len(stop) else 0, np.int64)
    last = np.zeros(len(run_begin), bool)
    if closing:
        last[stop - 1] = True
    whole = np.repeat(odd, runs)
    run_begin[~whole & ~last], run_count[~whole & ~last] = begins, counts
    run_begin[whole & ~last], run_count[whole & ~last] = apart_begins[len(starts) :], apart_counts[len(starts) :]
    total = np.concatenate(([0], np.cumsum(run_count)))
    return _gather(flat, run_begin, run_count), total[stop] - total[stop - runs]


def token_bytes(tokenizer) -> np.ndarray:
    """How many bytes of text each id of a byte-level vocabulary stands for."""
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():  # one printable character stands for one byte
        sizes[i] = len(token)
    return sizes
