"""Toxicity by a counterfactually regularised linear classifier.

Words and word beginnings that occur in a text are its features. For training sentences
with an identity term, copies with the term swapped are scored too, and the squared
change of the score is part of the loss; so neutral mentions of a group do not raise
the score. The model is fitted on a bounded sample of labelled rows and scores whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Identity terms by kind; a term is swapped with the others of its kind. Own lists.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


@dataclass(frozen=True)
class Settings:
    """positives, negatives: bounds of the labelled sample, taken in hash order of the ids.

    min_texts: sampled texts that a feature must occur in. prefixes: lengths of word beginnings.
    min_chi2: least chi-square of a feature against the label in the sample; it keeps the
    chance features of a large vocabulary out (6.63: one of a hundred passes by chance).
    ridge: weight decay. fairness: weight of the squared score change under swaps.
    """

    positives: int = 4000
    negatives: int = 8000
    min_texts: int = 3
    prefixes: tuple[int, ...] = (3, 4, 5)
    min_chi2: float = 6.63
    ridge: float = 2e-4
    fairness: float = 1.0
    swaps: int = 3
    steps: int = 250
    rate: float = 0.08
    threshold: float = 0.3
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS


def of_words(words: set[str], prefixes: tuple[int, ...]) -> set[str]:
    """Words and, marked by `*`, beginnings of longer words."""
    out = set(words)
    for n in prefixes:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


def features(text: str, prefixes: tuple[int, ...]) -> set[str]:
    return of_words(set(_WORD.findall(text.lower())), prefixes)


def swapped(text: str, terms: tuple[tuple[str, ...], ...], limit: int) -> list[set[str]]:
    """For each of up to `limit` swaps, the words of the sentence that holds identity terms, terms exchanged."""
    kinds = {t: kind for kind in terms for t in kind}
    out: list[set[str]] = []
    words = _WORD.findall(text.lower())
    present = [w for w in dict.fromkeys(words) if w in kinds]
    for shift in range(1, limit + 1) if present else ():
        change = {w: kinds[w][(kinds[w].index(w) + shift) % len(kinds[w])] for w in present}
        out.append({change.get(w, w) for w in words})
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    prefixes: tuple[int, ...]

    def score(self, text: str | None) -> float:
        """Probability of label 1; an empty or null text has the bias alone."""
        z = self.bias
        if text:
            get = self.weights.get
            z += sum(get(f, 0.0) for f in features(text, self.prefixes))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class _Rows:
    """Sparse 0/1 rows: entry i lies in row[i], column col[i]."""

    def __init__(self, rows: list[list[int]], columns: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.fromiter((c for r in rows for c in r), np.int64, len(self.row))
        self.n, self.columns = len(rows), columns

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.columns)


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray, settings: Settings = Settings()) -> Model:
    """Logistic loss with weights, ridge and the counterfactual penalty, minimised by Adam from zero."""
    number: dict[str, int] = {}  # each distinct feature is held once
    found = [
        np.fromiter((number.setdefault(f, len(number)) for f in sorted(features(t or "", settings.prefixes))), np.int64)
        for t in texts
    ]
    rows, seen = np.repeat(labels > 0, [len(f) for f in found]), np.concatenate(found) if found else np.empty(0, np.int64)
    hits, often = np.bincount(seen[rows], minlength=len(number)), np.bincount(seen, minlength=len(number))
    n, ones = float(len(texts)), float((labels > 0).sum())
    cross = hits * (n - ones - often + hits) - (often - hits) * (ones - hits)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.nan_to_num(n * cross**2 / (ones * (n - ones) * often * (n - often)))
    good = np.flatnonzero((often >= settings.min_texts) & (chi2 >= settings.min_chi2))
    place = np.full(len(number), -1)
    place[good] = np.arange(len(good))
    wanted = set(good.tolist())
    names = {i: f for f, i in number.items() if i in wanted}
    names = [names[i] for i in good.tolist()]
    index = {f: i for i, f in enumerate(names)}
    x = _Rows([sorted(p[p >= 0].tolist()) for p in (place[f] for f in found)], len(names))
    numbers = lambda fs: sorted(index[f] for f in fs if f in index)
    origin, copies = [], []
    for i, text in enumerate(texts):
        for words in swapped(text or "", settings.terms, settings.swaps):
            origin.append(i)
            copies.append(numbers(of_words(words, settings.prefixes)))
    xc, origin = _Rows(copies, len(names)), np.array(origin, np.int64)

    y, total = labels.astype(float), weight.sum() or 1.0
    share = float(np.clip((weight * y).sum() / total, 1e-4, 1 - 1e-4))
    w, b = np.zeros(len(names)), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, settings.steps + 1):
        p = squash(x.times(w) + b)
        g = weight * (p - y) / total
        gc = np.zeros(0)
        if len(origin):
            pc = squash(xc.times(w) + b)
            change = 2 * settings.fairness * weight[origin] * (p[origin] - pc) / total
            g = g + np.bincount(origin, change * (p * (1 - p))[origin], x.n)
            gc = -change * pc * (1 - pc)
        gw = x.transposed_times(g) + xc.transposed_times(gc) + settings.ridge * w
        gb = float(g.sum() + gc.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= settings.rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        b -= settings.rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return Model({f: float(a) for f, a in zip(names, w, strict=True) if abs(a) > 1e-4}, b, settings.prefixes)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, settings: Settings = Settings()
) -> Model:
    """Fit on at most `positives` + `negatives` labelled rows outside the held-out part.

    The sample is the first rows in hash order of (label, id), so it does not depend on the
    partitioning; each class is weighted by its rows in the whole. Rows with a null id or
    label are not learnt. Only the sampled texts come to the driver. Without labelled rows
    every score is one half.
    """
    usable = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))
    )
    counts = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    if not counts:
        return Model({}, 0.0, settings.prefixes)
    bounds = {1: settings.positives, 0: settings.negatives}
    parts = [
        usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(bounds[y]) for y in sorted(counts)
    ]
    sample = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # At most positives + negatives rows of two numbers, so it can be broadcast.
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort()
    y = np.array([r.y for r in rows])
    weight = np.array([counts[r.y] for r in rows], float)
    for label in (0, 1):
        weight[y == label] /= max((y == label).sum(), 1)
    if not len(rows):
        return Model({}, 0.0, settings.prefixes)
    return fit([r.text for r in rows], y, weight / weight.sum() * len(rows), settings)


def score(text: Column, model: Model) -> Column:
    """The score of every whole text; the model (features of a bounded sample) goes to each task."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return run(text)


def score_documents(docs: DataFrame, id_col: str, text_col: str, model: Model, threshold: float = Settings().threshold) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of `docs`, null and repeated ids too."""
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), score(F.col(f"`{text_col}`"), model).alias("score"))
    return picked.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
