"""SentencePiece BPE by vectorised merge rounds over flat symbol arrays.

All new words of a step lie one after another in one array of symbols. In a round every
word finds the smallest rank among its neighbouring pairs (a segmented minimum) and all
words merge at once, in each the leftmost places of that rank that do not overlap. The
array is then compacted, words without a pair leave it, and only pairs beside a merge are
looked up again. It ends when no pair remains.

One at a time, the library would look again at better pairs after each merge. A merge is
therefore *eager* where a neighbour could join the merged symbol at the same rank or a
better one; a word merges its places up to the first eager one and leaves those behind it
to later rounds. What the rounds give is thus what the library's queue gives.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from flowsift.llm.tokens import _gather, in_steps

#: The library's mark for a space.
SPACE = "▁"
_MARK = np.frombuffer(SPACE.encode(), np.uint8)
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NONE = np.iinfo(np.int32).max
#: Bytes of words and ids that a task keeps between its steps.
KEEP_BYTES = 64_000_000


class Vocabulary:
    """The tables of a model: symbols, ranked pairs, and the bytes of every id.

    A symbol is a piece's id, or `size + code point` for a character that is no piece.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, training, kinds = model.normalizer_spec, model.trainer_spec, [p.type for p in model.pieces]
        if training.model_type != proto.TrainerSpec.BPE or not training.byte_fallback:
            raise ValueError("the model must be BPE with byte fallback")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("the model must leave texts as they are and put one space before them")
        if training.treat_whitespace_as_suffix or not set(kinds) <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("user-defined and unused pieces, and spaces as suffixes, are not supported")
        self.size = len(kinds)
        scores = {p.piece: p.score for p, k in zip(model.pieces, kinds) if k == _NORMAL}
        ids = {p.piece: i for i, (p, k) in enumerate(zip(model.pieces, kinds)) if k == _NORMAL}
        steps = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self._read_ids(model.pieces, kinds, training.unk_surface)
        self.begin, self.end = training.bos_id, training.eos_id
        # Symbols of single characters, by code point.
        self.of_char = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        symbol = lambda s: ids.get(s, self.size + ord(s) if len(s) == 1 else None)
        self.run, tied = self._tied_run(ids, scores)
        pairs, beside = {}, set()
        for piece, i in ids.items():
            beside.update(zip(piece, piece[1:]))
            for k in range(1, len(piece) if piece not in tied else 0):
                left, right = symbol(piece[:k]), symbol(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (steps[scores[piece]], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        # Two characters that no piece holds side by side: nothing merges across them.
        self.beside = np.sort(np.array([ord(a) << 32 | ord(b) for a, b in beside], np.int64))

    @staticmethod
    def _tied_run(ids: dict[str, int], scores: dict[str, float]) -> tuple[np.ndarray | None, set[str]]:
        """What runs of SPACE merge into, and the pieces that are such runs, if their pairs come last.

        Pieces of several spaces must share the worst score, and no other piece may hold two
        spaces side by side. Their pairs then come after all others, from left to right. If the
        longest run (n spaces) becomes one piece, it does so at the left end of any longer run
        before anything behind it moves, and nothing joins it any more: a run is cut into
        whole pieces of n, and the rest merges alone. Row k of the table has, by position, the id
        that begins there in a run of k spaces, or -1.
        """
        runs = {p for p in ids if len(p) > 1 and set(p) == {SPACE}}
        worst = min(scores.values())
        alone = not any(SPACE * 2 in p for p in ids if p not in runs)
        last = all((s == worst) if p in runs else (s > worst or len(p) == 1) for p, s in scores.items())
        if not (runs and alone and last and SPACE in ids):
            return None, set()
        longest = max(map(len, runs))
        table = np.full((longest + 1, longest), -1, np.int32)
        for k in range(1, longest + 1):
            parts = [1] * k
            while (i := next((i for i, n in enumerate(zip(parts, parts[1:])) if SPACE * sum(n) in runs), -1)) >= 0:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            table[k, np.cumsum(parts) - parts] = [ids[SPACE * n] for n in parts]
        return (table, runs) if (table[longest, 1:] < 0).all() else (None, set())

    def _read_ids(self, pieces, kinds: list[int], unknown: str) -> None:
        """Bytes that each id decodes to, and the id of each single byte."""
        self.byte_id, out = np.zeros(256, np.int32), []
        for i, (piece, kind) in enumerate(zip(pieces, kinds)):
            if kind == _BYTE:
                value = int(piece.piece[3:5], 16)
                self.byte_id[value] = i
                out.append(bytes([value]))
            elif kind == _UNKNOWN:
                out.append(unknown.encode())
            else:
                out.append(b"" if kind == _CONTROL else piece.piece.replace(SPACE, " ").encode())
        self.sizes = np.array([len(b) for b in out], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.is_byte = np.array(kinds) == _BYTE
        self.is_space = np.array([k == _NORMAL and p.piece.startswith(SPACE) for p, k in zip(pieces, kinds)])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank _NONE where the pair is no piece."""
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32), np.zeros(len(left), np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), self.merged[at]


@functools.lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    """The tables of a model file, once per process."""
    return Vocabulary(path)


def _leftmost(places: np.ndarray) -> np.ndarray:
    """Of sorted places, those that a scan from the left takes when neighbours overlap."""
    first = np.diff(places, prepend=-2) != 1
    since = np.arange(len(places)) - np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
    return places[since % 2 == 0]


def _not_behind_eager(vocabulary, sym, rank, lead, places, merged, owner):
    """The places of each word up to the first whose merged symbol a neighbour joins at once."""
    best = rank[places]
    follows = np.append(places[1:] == places[:-1] + 2, False) if len(places) else np.zeros(0, bool)
    before = np.maximum(places - 1, 0)
    left = np.where(np.roll(follows, 1), np.roll(merged, 1), sym[before])
    after = np.minimum(places + 2, len(sym) - 1)
    joins = (~lead[places]) & (vocabulary.look_up(left, merged)[0] <= best)
    inside = (places + 2 < len(sym)) & ~lead[after]
    eager = joins | (inside & (vocabulary.look_up(merged, sym[after])[0] <= best))
    if not eager.any():
        return np.ones(len(places), bool)
    earlier = np.cumsum(eager) - eager
    first = np.searchsorted(owner, owner, "left")
    return earlier == earlier[first]


def merge_rounds(vocabulary: Vocabulary, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of words (sizes: symbols of each, none empty) until no pair remains.

    Returns the symbols left, in order, and how many each word has.
    """
    names = np.arange(len(sizes))
    out_sym, out_name, out_count = [], [], []
    lead = np.zeros(len(sym), bool)
    lead[np.cumsum(sizes) - sizes] = True
    rank = np.full(len(sym), _NONE, np.int32)
    inner = np.flatnonzero(~lead[1:])
    rank[inner] = vocabulary.look_up(sym[inner], sym[inner + 1])[0]
    while len(sym):
        starts = np.flatnonzero(lead)
        lengths = np.diff(np.append(starts, len(sym)))
        best = np.minimum.reduceat(rank, starts)
        done = best == _NONE
        if done.any():  # these words leave the arrays
            gone = np.repeat(done, lengths)
            out_sym.append(sym[gone])
            out_name.append(names[done])
            out_count.append(lengths[done])
            sym, rank, lead = sym[~gone], rank[~gone], lead[~gone]
            names, lengths, best = names[~done], lengths[~done], best[~done]
            if not len(sym):
                break
        places = _leftmost(np.flatnonzero(rank == np.repeat(best, lengths)))
        _, merged = vocabulary.look_up(sym[places], sym[places + 1])
        owner = np.searchsorted(np.cumsum(lengths), places, "right")
        taken = _not_behind_eager(vocabulary, sym, rank, lead, places, merged, owner)
        places, merged = places[taken], merged[taken]
        sym[places] = merged
        keep = np.ones(len(sym), bool)
        keep[places + 1] = False
        moved = places - np.arange(len(places))  # where the merged symbols are afterwards
        sym, rank, lead = sym[keep], rank[keep], lead[keep]
        last = np.append(lead[1:], True)
        rank[moved] = _NONE
        pairs = np.unique(np.concatenate((moved, moved[~lead[moved]] - 1)))
        pairs = pairs[~last[pairs]]
        rank[pairs] = vocabulary.look_up(sym[pairs], sym[pairs + 1])[0]
    if not out_sym:
        return sym, np.zeros(0, np.int64)
    name, count = np.concatenate(out_name), np.concatenate(out_count)
    flat, order = np.concatenate(out_sym), np.argsort(name)
    return _gather(flat, (np.cumsum(count) - count)[order], count[order]), count[order]


def _join_runs(vocabulary: Vocabulary, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of single spaces inside a word as the longest pieces from the left, and the rest."""
    table = vocabulary.run
    longest, space = table.shape[1], table[1, 0]
    at = np.flatnonzero(sym == space)
    if not (np.diff(at) == 1).any():
        return sym, word
    first = (np.diff(at, prepend=-2) != 1) | (np.diff(word[at], prepend=-1) != 0)
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, len(at)))
    nth, length = np.arange(len(at)) - np.repeat(begin, length), np.repeat(length, length)
    rest = length % longest
    piece = table[np.where(nth < length - rest, longest, rest), nth % longest]
    sym = sym.copy()
    sym[at] = piece
    keep = np.ones(len(sym), bool)
    keep[at] = piece >= 0
    return sym[keep], word[keep]


def _in_bytes(vocabulary: Vocabulary, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols as ids: a character that is no piece becomes the ids of its UTF-8 bytes."""
    unknown = sym >= vocabulary.size
    if not unknown.any():
        return sym, word
    encoded = [chr(c).encode("utf-8", "surrogatepass") for c in (sym[unknown] - vocabulary.size).tolist()]
    sizes = np.ones(len(sym), np.int64)
    sizes[unknown] = [len(b) for b in encoded]
    out = np.repeat(sym, sizes)
    out[np.repeat(unknown, sizes)] = vocabulary.byte_id[np.frombuffer(b"".join(encoded), np.uint8)]
    return out, np.repeat(word, sizes)


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each has; a space counts as SPACE."""
    text = b"".join(words).decode("utf-8", "replace").replace(" ", SPACE)
    if not text:
        return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    of_word = np.repeat(np.arange(len(words)), [len(w.decode("utf-8", "replace")) for w in words])
    # Words are cut further where no piece could ever lie across.
    key = chars[:-1].astype(np.int64) << 32 | chars[1:]
    beside = vocabulary.beside
    at = np.minimum(np.searchsorted(beside, key), len(beside) - 1) if len(beside) else None
    together = beside[at] == key if len(beside) else np.zeros(len(key), bool)
    starts = np.flatnonzero(np.append(True, ~together | (of_word[1:] != of_word[:-1])))
    sizes = np.diff(np.append(starts, len(chars)))
    sym, counts = merge_rounds(vocabulary, vocabulary.of_char[chars], sizes)
    word = np.repeat(of_word[starts], counts)
    if vocabulary.run is not None:
        sym, word = _join_runs(vocabulary, sym, word)
    sym, word = _in_bytes(vocabulary, sym, word)
    return sym.astype(np.uint32), np.bincount(word, minlength=len(words)).astype(np.int64)


class _Known:
    """Ids of words met so far, up to KEEP_BYTES; lives as long as its task."""

    def __init__(self, vocabulary: Vocabulary, keep_bytes: int):
        self.vocabulary, self.room, self.slots = vocabulary, keep_bytes, {}
        self.flat, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, where those of each word (distinct ones) begin, and how many they are."""
        new = [w for w in words if w not in self.slots]
        ids, sizes = encode_words(self.vocabulary, new)
        flat, counts = np.concatenate((self.flat, ids)), np.concatenate((self.counts, sizes))
        fresh = dict(zip(new, range(len(self.counts), len(counts))))
        slots = np.fromiter((self.slots[w] if w in self.slots else fresh[w] for w in words), np.int64, len(words))
        cost = sum(map(len, new)) + 4 * len(ids) + 150 * len(new)  # keys, ids, and the entries themselves
        if cost <= self.room:
            self.room -= cost
            self.slots.update(fresh)
            self.flat, self.counts = flat, counts
        return flat, (np.cumsum(counts) - counts)[slots], counts[slots]


def _words(texts: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of all texts, each with the spaces before it, and how many each text has.

    A text is cut before every run of spaces. After a written-out SPACE character it is not cut.
    """
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[: offsets[-1]] if buffer else np.zeros(0, np.uint8)
    cut = data == 0x20
    cut[1:] &= data[:-1] != 0x20
    if len(data) > 3:
        cut[3:] &= (data[:-3] != _MARK[0]) | (data[1:-2] != _MARK[1]) | (data[2:-1] != _MARK[2])
    filled = np.diff(offsets) > 0
    cut[offsets[:-1][filled]] = True
    cut[: offsets[0]] = False
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, offsets[-1]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), buffer or pa.py_buffer(b"")])
    return words, np.diff(np.searchsorted(starts, offsets))


def encode_step(known: _Known, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another with begin and end ids, and how many each text has."""
    vocabulary = known.vocabulary
    words, in_text = _words(pc.fill_null(texts.cast(pa.large_string()), ""))
    distinct = words.dictionary_encode()
    codes = distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    flat, begins, counts = known.look_up(distinct.dictionary.to_pylist())
    n = len(flat)
    flat = np.concatenate((flat, np.array([vocabulary.begin, vocabulary.end], np.uint32)))
    # Each text: its begin id, its words, its end id, as runs of `flat`.
    runs = in_text + 2
    run_begin, run_count = np.empty(int(runs.sum()), np.int64), np.ones(int(runs.sum()), np.int64)
    stop = np.cumsum(runs)
    edge = np.zeros(len(run_begin), bool)
    edge[stop - 1] = edge[stop - runs] = True
    run_begin[~edge], run_count[~edge] = begins[codes], counts[codes]
    run_begin[stop - runs], run_begin[stop - 1] = n, n + 1
    total = np.concatenate(([0], np.cumsum(run_count)))
    return _gather(flat, run_begin, run_count), total[stop] - total[stop - runs]


def decode_rows(vocabulary: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The UTF-8 text of each row's ids: the first space goes, bytes that are no UTF-8 become U+FFFD.

    Each id is at most the vocabulary's size less one.
    """
    length = vocabulary.sizes[ids].copy()
    begin = vocabulary.begins[ids].copy()
    said = np.flatnonzero(length > 0)
    ends = np.cumsum(sizes)
    first = np.searchsorted(said, ends - sizes)
    first = said[first[first < len(said)]]
    first = np.unique(first)  # the first id of each row that says something; of rows that say nothing, the next row's
    first = first[vocabulary.is_space[ids[first]]]
    begin[first] += 1
    length[first] -= 1
    data = _gather(vocabulary.bytes, begin, length).tobytes()
    total = np.concatenate(([0], np.cumsum(length)))
    # Rows with single bytes are joined from runs: each run of bytes must be UTF-8 by itself.
    fallback = vocabulary.is_byte[ids]
    some = np.concatenate(([0], np.cumsum(fallback)))
    out = []
    for a, b, mixed in zip((ends - sizes).tolist(), ends.tolist(), (some[ends] > some[ends - sizes]).tolist()):
        if not mixed:
            out.append(data[total[a] : total[b]])
            continue
        edges = [a, *(a + 1 + np.flatnonzero(fallback[a + 1 : b] != fallback[a : b - 1])).tolist(), b]
        runs = ((data[total[i] : total[j]], fallback[i]) for i, j in zip(edges, edges[1:]))
        out.append(b"".join(_repaired(r) if single else r for r, single in runs))
    return out


def _repaired(data: bytes) -> bytes:
    """`data` with every byte that is not part of a UTF-8 character replaced by U+FFFD."""
    out, at = [], 0
    while at < len(data):
        try:
            data[at:].decode()
            out.append(data[at:])
            break
        except UnicodeDecodeError as error:
            good = at + error.start
            out += [data[at:good], "�".encode()]
            at = good + 1
    return b"".join(out)


def _parts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    return (step for batch in batches for step in in_steps(batch, column))


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of `sizes` bytes each, cut from one buffer."""
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def encode_documents(docs: DataFrame, id_col: str, text_col: str, model_path: str, keep_bytes: int = KEEP_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit numbers, with begin and end ids.

    A null or empty text has its begin and end ids alone. Null and repeated doc_ids keep
    rows of their own; other columns play no part; no documents, no rows. A document is one
    row and must fit a task. Only words repeat work between steps: a lost task is run again
    from its own rows.
    """

    def run(batches):
        known = _Known(load_vocabulary(model_path), keep_bytes)
        for step in _parts(batches, 1):
            ids, sizes = encode_step(known, step.column(1))
            packed = _binaries(ids.astype("<u4"), 4 * sizes)
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(sizes), packed], names=["doc_id", "n_tokens", "ids"])

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the UTF-8 text that the ids stand for; null ids decode to null."""

    def run(batches):
        vocabulary = load_vocabulary(model_path)
        for step in _parts(batches, 2):
            column = pc.fill_null(step.column(2).cast(pa.large_binary()), b"")
            sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // 4
            ids = np.frombuffer(b"".join(column.to_pylist()), "<u4")
            decoded = pa.array(decode_rows(vocabulary, ids, sizes), pa.binary())
            decoded = pc.if_else(step.column(2).is_null(), pa.scalar(None, pa.binary()), decoded)
            yield pa.RecordBatch.from_arrays([*step.columns, decoded], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded binary"
    )
