"""Quality by compression bands: zstandard ratios of the whole text and of its chunks.

Repetitive text compresses too well, random or encoded text too badly. What is normal
depends on the length, so each length class has its own band. Counts of words, symbols,
repeated lines and repeated word windows stand beside the verdict.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowsift.llm.common import fresh_name
from flowsift.llm.tokens import in_steps

WHITE_SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Ratio limits (uncompressed by compressed bytes) of each length class.

    A text of b bytes is in the first class with b < below; `below` None has no end.
    Chunks of `chunk` bytes are judged in texts of at least two, by `chunk_low` and
    `chunk_high`; the text fails if more than `bad_chunks` of them fall outside.
    """

    limits: tuple[tuple[int | None, float, float], ...] = (
        (64, 0.0, 4.0),
        (256, 0.7, 2.6),
        (1024, 1.15, 3.2),
        (4096, 1.35, 4.0),
        (16384, 1.4, 5.0),
        (None, 1.4, 6.0),
    )
    chunk: int = 4096
    chunk_low: float = 1.35
    chunk_high: float = 6.0
    bad_chunks: float = 0.25
    level: int = 3

    def band(self, size: int) -> tuple[float, float]:
        edges = [b for b, *_ in self.limits if b is not None]
        return self.limits[bisect.bisect_right(edges, size)][1:]


@functools.lru_cache(maxsize=4)
def _compressor(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level)


def ratio(data: bytes, level: int = 3) -> float:
    return len(data) / len(_compressor(level).compress(data)) if data else 0.0


def repeated_window_words(codes: np.ndarray, vocabulary: int, width: int = 5) -> int:
    """How many words lie in a window of `width` words that occurs twice or more."""
    windows = len(codes) - width + 1
    if windows < 2:
        return 0
    key, base = codes[:windows].astype(np.int64), vocabulary
    for j in range(1, width):
        if base * vocabulary >= 1 << 62:  # exact all the same: number the distinct prefixes anew
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            base = int(key.max()) + 1
        key = key * vocabulary + codes[j : j + windows]
        base *= vocabulary
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    repeated = np.zeros(windows, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None, bands: Bands) -> tuple:
    """All figures of one text, in the order of FIELDS."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    word_chars = len(text or "") - (len(data) - len(data.translate(None, WHITE_SPACE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    repeat = repeated_window_words(codes, max(len(index), 1))
    whole = ratio(data, bands.level)
    chunks = len(data) // bands.chunk if len(data) >= 2 * bands.chunk else 0
    bad = 0
    for i in range(chunks):
        part = ratio(data[i * bands.chunk : (i + 1) * bands.chunk], bands.level)
        bad += not bands.chunk_low <= part <= bands.chunk_high
    failed = n < 10 or 100 * repeat > 20 * n
    low, high = bands.band(len(data))
    kept = not failed and low <= whole <= high and bad <= bands.bad_chunks * chunks
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeat, len(data), whole, chunks, bad, failed, kept


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, "
    "ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"
)
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]
_KINDS = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.split()[1]] for f in FIELDS.split(", ")]


def assess(text: Column, bands: Bands = Bands()) -> Column:
    """The figures and the verdict of a text column as one struct; a null text has no words and fails."""

    @F.arrow_udf(f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            steps = in_steps(pa.RecordBatch.from_arrays([texts], names=["text"]), 0)  # bounded in bytes
            columns = zip(*(measure(t, bands) for step in steps for t in step.column(0).to_pylist()), strict=True)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, _KINDS, strict=False)] or [pa.nulls(0, k) for k in _KINDS]
            yield pa.StructArray.from_arrays(arrays, names=_NAMES)

    return run(text)


def quality(docs: DataFrame, text_col: str, bands: Bands = Bands(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """`keep` (all) columns of `docs` and the figures; every row stays. Input columns named like a figure are replaced."""
    kept = [c for c in (keep or docs.columns) if c.lower() not in _NAMES]
    name = fresh_name([*docs.columns], "figures")
    measured = docs.select(*[F.col(f"`{c}`") for c in kept], assess(F.col(f"`{text_col}`"), bands).alias(name))
    return measured.select(*[F.col(f"`{c}`") for c in kept], f"{name}.*")


def keep_quality(docs: DataFrame, text_col: str, bands: Bands = Bands()) -> DataFrame:
    """The rows of `docs` that pass, columns unchanged."""
    name = fresh_name([*docs.columns], "figures")
    judged = docs.withColumn(name, assess(F.col(f"`{text_col}`"), bands)["kept"])
    return judged.where(F.col(name)).drop(name)
