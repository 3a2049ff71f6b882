"""N-gram Jaccard join by banded MinHash, with exact verification.

Every text has one signature per band. The bands are tries of an LSH forest cut at one
depth, fixed beforehand: the longest prefix with which texts at the threshold meet in some
band with the target probability. Nothing is sorted or shortened at run time. Texts that
meet, directly or through others, form candidate groups (star edges to the smallest key
of a prefix, never pairs).
Inside a group, texts whose sizes allow the threshold are compared exactly, in blocks.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flowsift.llm.common import store
from flowsift.llm.components import connected_components
from flowsift.llm.linking import LINKS, block_count, block_of, local_groups, resolve


@dataclass(frozen=True)
class Forest:
    """words: shingle width. threshold: least Jaccard similarity of a link.

    tries, depth: number of prefix tries and their full depth. target: least probability
    that two texts exactly at the threshold meet; it fixes how far prefixes are shortened.
    block, block_bytes: what one side of a comparison unit holds on average.
    """

    words: int = 5
    threshold: float = 0.8
    tries: int = 40
    depth: int = 8
    target: float = 0.9999
    block: int = 512
    block_bytes: int = 4_000_000
    seed: int = 11

    @functools.cached_property
    def prefix(self) -> int:
        """The longest prefix that reaches the target recall at the threshold."""
        for k in range(self.depth, 0, -1):
            if 1 - (1 - self.threshold**k) ** self.tries >= self.target:
                return k
        raise ValueError("too few tries for the target recall")


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class _WordHashes(dict):
    """64-bit hash of each word; emptied when it holds many, to bound memory."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = value
        return value


def _windows(n: int, width: int) -> int:
    return max(1, n - width + 1) if n else 0


def shingle_hashes(words: list[bytes], width: int, cache: dict) -> np.ndarray:
    """Distinct 64-bit hashes of the windows; a shorter text is one window."""
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    count = len(words) - span + 1
    h = np.full(count, span, np.uint64)
    for j in range(span):
        h = (h ^ (codes[j : j + count] * _MIX[j % 5])) * _MIX[(j + 1) % 5]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over all shingles, in steps of bounded memory."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 4096):
        values = a[:, None] * short[None, i : i + 4096]
        values += b[:, None]
        values ^= values >> np.uint32(15)
        np.minimum(low, values.min(axis=1), out=low)
    return low


def prefix_keys(low: np.ndarray, forest: Forest) -> np.ndarray:
    """One 64-bit key per trie for its prefix of the signature."""
    grid = low.reshape(forest.tries, forest.depth)[:, : forest.prefix].astype(np.uint64)
    key = np.arange(1, forest.tries + 1, dtype=np.uint64) * _MIX[0]
    for j in range(forest.prefix):
        key = (key ^ grid[:, j]) * _MIX[1]
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _signed(docs: DataFrame, id_col: str, text_col: str, forest: Forest) -> DataFrame:
    """(doc_id, key, n_shingles, n_bytes, tries): one pass over whole texts."""
    draw = np.random.default_rng(forest.seed)
    a = draw.integers(0, 1 << 31, forest.tries * forest.depth, np.uint32) * np.uint32(2) + np.uint32(1)
    b = draw.integers(0, 1 << 32, forest.tries * forest.depth, np.uint32)
    used = (np.arange(forest.tries * forest.depth) % forest.depth) < forest.prefix
    a_used, b_used = a[used], b[used]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _WordHashes()
        for batch in batches:
            sizes, keys, lengths = [], [], []
            for text in batch["text"]:
                data = (text or "").encode("utf-8", "surrogatepass")
                hashes = shingle_hashes(data.split(), forest.words, cache)
                low = np.zeros(len(used), np.uint32)
                if len(hashes):
                    low[used] = signature(hashes, a_used, b_used)
                sizes.append(len(hashes))
                lengths.append(len(data))
                keys.append(prefix_keys(low, forest) if len(hashes) else np.empty(0, np.int64))
                if len(cache) > 300_000:
                    cache.clear()
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "key": batch["key"], "n_shingles": sizes, "n_bytes": lengths, "tries": keys}
            )

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    return picked.mapInPandas(run, "doc_id long, key string, n_shingles int, n_bytes long, tries array<long>")


def text_key(text):
    """Equal for equal texts and, short of an MD5 collision, for no others."""
    return F.md5(text.cast("binary"))


def window_numbers(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, window) pairs; windows are numbered exactly, by their words."""
    index: dict[bytes, int] = {}
    rows, keys = [], []
    short: dict[tuple, int] = {}
    short_rows, short_keys = [], []
    coded = []
    for i, data in enumerate(texts):
        words = data.split()
        if 0 < len(words) < width:
            short_rows.append(i)
            short_keys.append(short.setdefault(tuple(words), len(short)))
        coded.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
    n_words = max(len(index), 1)
    parts = [np.zeros((max(0, len(c) - width + 1), 0), np.int64) for c in coded]
    rows = np.concatenate([np.full(len(p), i) for i, p in enumerate(parts)]) if parts else np.empty(0, np.int64)
    column = lambda j: np.concatenate([c[j : j + max(0, len(c) - width + 1)] for c in coded])
    key, base = column(0), n_words
    for j in range(1, width):
        if base * n_words >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            base = int(key.max()) + 1 if len(key) else 1
        key = key * n_words + column(j)
        base *= n_words
    key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    n_keys = int(key.max()) + 1 if len(key) else 0
    rows = np.concatenate([rows, np.array(short_rows, np.int64)])
    key = np.concatenate([key, np.array(short_keys, np.int64) + n_keys])
    pair = np.unique(rows * (n_keys + len(short) + 1) + key)
    return pair // (n_keys + len(short) + 1), pair % (n_keys + len(short) + 1)


def similar(texts: list[bytes], width: int, threshold: float) -> np.ndarray:
    """Which pairs have Jaccard similarity of at least the threshold, exactly.

    Windows that only one text has add nothing to a common count and are left out of the
    product; the rest is multiplied in column steps of bounded memory.
    """
    n = len(texts)
    rows, keys = window_numbers(texts, width)
    sizes = np.bincount(rows, minlength=n).astype(np.int64)
    keys, inverse, often = np.unique(keys, return_inverse=True, return_counts=True)
    shared = often[inverse] > 1
    rows, inverse = rows[shared], inverse[shared]
    number = np.cumsum(often > 1) - 1
    columns = number[inverse]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((n, n), np.float32)
    width_step = max(256, 8_000_000 // max(n, 1))
    for low in range(0, int(columns[-1]) + 1 if len(columns) else 0, width_step):
        a, b = np.searchsorted(columns, (low, low + width_step))
        part = np.zeros((n, min(width_step, int(columns[b - 1]) - low + 1)), np.float32)
        part[rows[a:b], columns[a:b] - low] = 1
        common += part @ part.T
    both = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    # both / union >= threshold in whole numbers
    scaled = round(threshold * 1_000_000)
    linked = (both * 1_000_000 >= scaled * union) & (both > 0)
    np.fill_diagonal(linked, False)
    return linked


def _compare(forest: Forest):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, links, roots = [], [], []
        for _, part in pdf.groupby("sub", sort=False):
            part = part.drop_duplicates(["key", "side"]).sort_values("key")
            if len(part) < 2:
                continue
            linked = similar([t.encode("utf-8", "surrogatepass") for t in part["text"]], forest.words, forest.threshold)
            if part["crosses"].iloc[0]:
                side = part["side"].to_numpy()
                linked &= side[:, None] != side[None, :]
            label = local_groups(linked)
            count = linked @ part["members"].to_numpy(np.int64)
            names = part["key"].to_numpy()
            hit = linked.any(axis=1)
            keys += list(names[hit])
            links += list(count[hit])
            roots += list(names[label[hit]])
        return pd.DataFrame({"key": keys, "links": np.array(links, np.int64), "root": roots}).astype({"key": object, "root": object})

    return run


def _units(members: DataFrame, forest: Forest) -> DataFrame:
    """(key, members, doc_id, unit, sub, side, crosses): which classes are compared in which unit.

    Groups of at most one block stay together, many in a unit. Larger ones are cut by size
    class (sizes of linked texts differ by a factor of at most 1/threshold, so by one class
    at most) and by blocks; every pair of blocks that can hold links is a unit. A unit that
    crosses two blocks counts links between its sides only, also where one side has no class.
    """
    group = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    blocks = F.greatest(block_count(F.col("n"), forest.block), block_count(F.col("bytes"), forest.block_bytes))
    group = group.where("n > 1").select("component", (blocks > 1).alias("large"))
    known, _ = store(members.join(group, "component"), "candidates")
    packed = known.where(~F.col("large")).agg(F.sum("n_bytes")).first()[0] or 0
    bins = max(1, packed // forest.block_bytes)  # so that a bin of small groups holds about block_bytes
    small = known.where(~F.col("large")).select(
        "key", "members", "doc_id",
        F.pmod(F.xxhash64("component"), F.lit(bins)).cast("string").alias("unit"),
        F.col("component").alias("sub"), F.lit(0).alias("side"), F.lit(False).alias("crosses"),
    )
    ratio = math.log(1 / forest.threshold)
    sized = known.where("large").withColumn("c", F.floor(F.log(F.col("n_shingles").cast("double")) / ratio + 1e-9).cast("int"))
    stats = sized.groupBy("component", "c").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    stats = stats.select("component", "c", blocks.alias("nb"))
    above = stats.select("component", (F.col("c") - 1).alias("c"), F.col("nb").alias("above"))
    below = stats.select("component", (F.col("c") + 1).alias("c"), F.col("nb").alias("below"))
    stats = stats.join(above, ["component", "c"], "left").join(below, ["component", "c"], "left")
    placed = sized.join(stats, ["component", "c"]).withColumn("at", block_of(F.col("key"), F.col("nb")))

    def units(count, make):
        numbers = F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), F.coalesce(count, F.lit(0)) - 1))
        return F.transform(F.coalesce(numbers, F.array().cast("array<int>")), make)

    def unit(low, i, high, j, side, crosses):
        sub = F.concat_ws("/", "component", low, i, high, j)
        return F.struct(sub.alias("sub"), side.cast("int").alias("side"), crosses.alias("crosses"))

    c, at = F.col("c"), F.col("at")
    same = units(F.col("nb"), lambda x: unit(c, F.least(at, x), c, F.greatest(at, x), at > x, at != x))
    up = units(F.col("above"), lambda x: unit(c, at, c + 1, x, F.lit(0), F.lit(True)))
    down = units(F.col("below"), lambda x: unit(c - 1, x, c, at, F.lit(1), F.lit(True)))
    large = placed.select("key", "members", "doc_id", F.explode(F.concat(same, up, down)).alias("u")).select(
        "key", "members", "doc_id", F.col("u.sub").alias("unit"), F.col("u.sub").alias("sub"), "u.side", "u.crosses"
    )
    return small.unionByName(large)


def jaccard_join(docs: DataFrame, id_col: str, text_col: str, forest: Forest = Forest()) -> DataFrame:
    """One row per document: doc_id, n_links, component_id, kept, key.

    Two documents are linked if their texts are equal or the Jaccard similarity of their sets
    of word windows is at least the threshold. A text of fewer words than a window is one
    window. Null, empty and blank texts link with nothing. n_links counts the linked
    documents, component_id is the smallest doc_id reachable by links, kept marks
    that document. Repeated rows count as documents of their own (rows with the
    component's id are all kept); null ids are counted but never name a component that has
    another id. Other columns of `docs` play no part; no documents give no rows.
    """
    signed, _ = store(_signed(docs, id_col, text_col, forest), "signatures")
    classes, _ = store(
        signed.groupBy("key").agg(
            F.count("*").alias("members"), F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"),
            F.first("n_bytes").alias("n_bytes"), F.first("tries").alias("tries"),
        ),
        "text-classes",
    )
    met = classes.select("key", F.explode("tries").alias("prefix"))
    heads = met.groupBy("prefix").agg(F.min("key").alias("head"), F.max("key").alias("tail")).where("head <> tail")
    edges = met.join(heads, "prefix").where("key <> head").select(F.col("key").alias("u"), F.col("head").alias("v"))
    groups = connected_components(edges)
    slim = classes.drop("tries").withColumn("linkable", F.col("n_shingles") > 0)
    members = slim.join(groups, F.col("key") == F.col("node")).withColumnRenamed("first_id", "doc_id")
    units = _units(members, forest)
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("d_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).withColumn("d_key", text_key(F.col("text")))
    compared = texts.join(units, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_key") == F.col("key")))
    links = (
        compared.select("unit", "sub", "side", "crosses", "key", "members", "text").groupBy("unit").applyInPandas(_compare(forest), LINKS)
    )
    links, _ = store(links, "links")
    return resolve(signed.select("doc_id", "key"), slim, links, "doc_id")


def keep_representatives(docs: DataFrame, id_col: str, text_col: str, forest: Forest = Forest()) -> DataFrame:
    """The rows of `docs` with one document of each linked group, columns unchanged.

    The one with the smallest id stays; of repeated rows with that id and text any one
    stays. Documents that cannot be linked (no words) stay, repeated rows once.
    """
    judged = jaccard_join(docs, id_col, text_col, forest)
    chosen = judged.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        *[F.col(f"`{c}`").alias(names[c]) for c in docs.columns],
        F.col(f"`{id_col}`").cast("long").alias("own_id"),
        text_key(text).alias("own_key"),
    )
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_key") == F.col("kept_key"))
    kept = rows.join(chosen, same, "left_semi").dropDuplicates(["own_id", "own_key"])
    return kept.select(*[F.col(names[c]).alias(c) for c in docs.columns])
