"""Language by Bayesian fusion of text, declared language, address suffix and host.

Text likelihoods come from character trigrams counted over all labelled texts. The
reliability of declarations and suffixes, and the languages of each host, are grouped
sums of text posteriors; hosts are smoothed towards their domain, domains towards the
whole. The posterior multiplies prior and likelihoods. A text that a uniform trigram
model explains better than every language is in none of them, whatever is declared.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowsift.llm.common import fresh_name, store, with_salt
from flowsift.llm.tokens import in_steps

BUCKETS = 1 << 15
SLICE = 1 << 20  # characters in one numpy step


@dataclass(frozen=True)
class Settings:
    """languages: those that can be told apart. evidence: trigrams that a long text counts as.

    smoothing: pseudo-records that a host or domain takes from the level above.
    min_grams, min_confidence: below either, a text is rejected as undetermined.
    """

    languages: tuple[str, ...] = ("de", "en", "es", "fr")
    evidence: int = 40
    smoothing: float = 20.0
    min_grams: int = 3
    min_confidence: float = 0.5
    salts: int = 32
    #: Host tables up to this many rows are broadcast; larger ones are joined by salted keys.
    broadcast_hosts: int = 50_000


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code below 2^16 its lower-case code if it is a letter, else 0."""
    table = np.zeros(1 << 16, np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def trigram_buckets(text: str) -> np.ndarray:
    """The hash bucket of every trigram that has a letter in its middle."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 1 << 16, _letters()[np.minimum(codes, (1 << 16) - 1)], codes)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(17))[b > 0]


def _slices(text: str) -> Iterator[str]:
    for i in range(0, max(len(text), 1), SLICE):
        yield text[max(0, i - 1) : i + SLICE + 1] if i else text[: SLICE + 1]


def count_trigrams(labelled: DataFrame, text_col: str, lang_col: str, settings: Settings) -> DataFrame:
    """(lang, bucket, n) over all labelled texts in one of the languages; counted before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {lang: np.zeros(BUCKETS, np.int64) for lang in settings.languages}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                parts, size = [], 0
                for text in texts:
                    parts.append(text)
                    size += len(text)
                    if size >= SLICE:
                        for piece in _slices(" ".join(parts)):
                            totals[lang] += np.bincount(trigram_buckets(piece), minlength=BUCKETS)
                        parts, size = [], 0
                for piece in _slices(" ".join(parts)):
                    totals[lang] += np.bincount(trigram_buckets(piece), minlength=BUCKETS)
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at]})

    picked = labelled.select(
        F.lower(F.col(f"`{lang_col}`").cast("string")).alias("lang"), F.col(f"`{text_col}`").alias("text")
    ).where(F.col("lang").isin(*settings.languages) & F.col("text").isNotNull())
    return picked.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_text_model(labelled: DataFrame, text_col: str, lang_col: str, settings: Settings) -> np.ndarray:
    """Log-likelihoods (bucket x language). At most BUCKETS rows per language come to the driver."""
    counts = np.full((BUCKETS, len(settings.languages)), 0.5)
    for lang, bucket, n in count_trigrams(labelled, text_col, lang_col, settings).collect():
        counts[bucket, settings.languages.index(lang)] += n
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def text_evidence(text: Column, model: np.ndarray, settings: Settings) -> Column:
    """struct(n_grams, loglik): letters' trigrams and their mean log-likelihood times the evidence that counts."""

    @F.arrow_udf("struct<n_grams:long,loglik:array<double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, logliks = [], []
            for step in in_steps(pa.RecordBatch.from_arrays([texts], names=["text"]), 0):  # bounded in bytes
                for text in step.column(0).to_pylist():
                    n, total = 0, np.zeros(model.shape[1])
                    for piece in _slices(text or ""):
                        buckets = trigram_buckets(piece)
                        n += len(buckets)
                        total += model[buckets].sum(axis=0, dtype=np.float64)
                    counts.append(n)
                    logliks.append((total * (min(n, settings.evidence) / max(n, 1))).tolist())
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(logliks, pa.list_(pa.float64()))], names=["n_grams", "loglik"]
            )

    return run(text)


def in_some_language(settings: Settings) -> Column:
    """Over `text_evidence`: letters enough, and some language as likely as trigrams drawn uniformly from all buckets."""
    counted = F.least(F.col("n_grams"), F.lit(settings.evidence))
    known = F.array_max("loglik") >= F.lit(-float(np.log(BUCKETS))) * counted
    return (F.col("n_grams") >= settings.min_grams) & known


def host_of(address: Column) -> Column:
    """Lower-case host of an address with or without scheme, user, port and path."""
    rest = F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\.$", "")


def declared_language(markup: Column) -> Column:
    """The primary subtag that an HTML text declares on its root element, or the empty text."""
    return F.lower(F.regexp_extract(markup, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))


def markup_text(markup: Column) -> Column:
    """The text of an HTML page without scripts, styles, comments and tags."""
    return F.regexp_replace(
        markup, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " "
    )


def _softmax(loglik: Column, size: int) -> list[Column]:
    top = F.array_max(loglik)
    parts = [F.exp(loglik[i] - top) for i in range(size)]
    total = functools.reduce(lambda a, b: a + b, parts)
    return [p / total for p in parts]


def _smoothed(counts: list[Column], parents: list[Column], weight: float) -> list[Column]:
    total = functools.reduce(lambda a, b: a + b, counts) + weight
    return [(c + F.lit(weight) * p) / total for c, p in zip(counts, parents, strict=True)]


def _host_table(evidence: DataFrame, settings: Settings) -> tuple[DataFrame, dict[str, list[float]]]:
    """(host, host_loglik) with prior and suffix likelihood in one, and the declarations' log-likelihoods.

    Sums are made per host first, then per domain and suffix, so no key gathers rows.
    Texts in none of the languages say nothing about hosts and declarations.
    """
    k = len(settings.languages)
    names = [f"s{i}" for i in range(k)]
    add = [F.sum(n).alias(n) for n in names]
    soft = evidence.where(in_some_language(settings)).select(
        "host", "declared", *[c.alias(n) for c, n in zip(_softmax(F.col("loglik"), k), names, strict=True)]
    )
    declared = {r[0]: list(r[1:]) for r in soft.groupBy("declared").agg(*add).collect()}
    whole = np.array(list(declared.values())).sum(axis=0) if declared else np.zeros(k)
    kinds = [*settings.languages, "other", ""]
    spoken = {d: np.log((np.array(declared.get(d, [0.0] * k)) + 1) / (whole + len(kinds))).tolist() for d in kinds}
    prior = ((whole + 1) / (whole.sum() + k)).tolist()

    labels = F.split("host", r"\.")
    dotted = F.size(labels) >= 2
    hosts, _ = store(
        soft.groupBy("host")
        .agg(*add)
        .withColumn("domain", F.when(dotted, F.substring_index("host", ".", -2)).otherwise(F.col("host")))
        .withColumn("suffix", F.when(dotted, F.substring_index("host", ".", -1)).otherwise(F.lit(""))),
        "hosts",
    )
    domains = hosts.groupBy("domain").agg(*[F.sum(n).alias(f"d{n}") for n in names])
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(n).alias(f"x{n}") for n in names])
    n_suffixes = suffixes.count() + 1
    joined = hosts.join(domains, "domain").join(suffixes, "suffix")
    domain = _smoothed([F.col(f"d{n}") for n in names], [F.lit(p) for p in prior], settings.smoothing)
    host = _smoothed([F.col(n) for n in names], domain, settings.smoothing)
    loglik = [
        F.log(h) + F.log((F.col(f"x{n}") + 1) / F.lit(float(w + n_suffixes)))
        for h, n, w in zip(host, names, whole, strict=True)
    ]
    spoken["prior"] = [float(np.log(p / (w + n_suffixes))) for p, w in zip(prior, whole, strict=True)]
    return joined.select("host", F.array(*loglik).alias("host_loglik")), spoken


def identify(
    records: DataFrame,
    text: Column,
    declared: Column,
    address: Column,
    model: np.ndarray,
    settings: Settings = Settings(),
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """`keep` (all) columns of `records`, then lang, confidence, n_grams, posterior, lang_kept.

    Texts with fewer than min_grams letter trigrams, empty and null ones too, are `und` with
    confidence 0 and not kept, and so are texts in none of the languages; texts whose best
    language is below min_confidence are `und` and not kept.
    Null declarations and addresses are no evidence; an unknown declaration counts as
    "other". Equal posteriors go to the language listed first. Repeated rows are judged
    alike and all stay. Input columns named like a result are replaced.
    """
    k = len(settings.languages)
    results = ("lang", "confidence", "n_grams", "posterior", "lang_kept")
    kept = list(keep or records.columns)
    names = {c: f"c{i}" for i, c in enumerate(kept)}
    said = F.lower(F.regexp_extract(F.coalesce(declared.cast("string"), F.lit("")), r"^\s*([A-Za-z]+)", 1))
    evidence = records.select(
        *[F.col(f"`{c}`").alias(names[c]) for c in kept],
        host_of(address).alias("host"),
        F.when(said.isin(*settings.languages, ""), said).otherwise(F.lit("other")).alias("declared"),
        text_evidence(text, model, settings).alias("e"),
    ).select("*", "e.n_grams", "e.loglik").drop("e")
    evidence, _ = store(evidence, "language-evidence")
    hosts, spoken = _host_table(evidence, settings)
    if hosts.limit(settings.broadcast_hosts + 1).count() <= settings.broadcast_hosts:
        joined = evidence.join(F.broadcast(hosts), "host", "left")
    else:
        salted = with_salt(evidence, settings.salts, "salt")
        copies = hosts.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(settings.salts)])))
        joined = salted.join(copies, ["host", "salt"], "left")
    table = F.create_map(
        *[x for d in spoken if d != "prior" for x in (F.lit(d), F.array(*[F.lit(v) for v in spoken[d]]))]
    )
    prior = F.coalesce("host_loglik", F.array(*[F.lit(v) for v in spoken["prior"]]))
    fused = F.zip_with(
        F.zip_with("loglik", F.element_at(table, F.col("declared")), lambda a, b: a + b), prior, lambda a, b: a + b
    )
    joined = joined.withColumn("fused", fused)
    posterior = F.array(*_softmax(F.col("fused"), k))
    judged = joined.withColumn("post", posterior).withColumn("best", F.array_max("post"))
    enough = in_some_language(settings)
    found = F.element_at(
        F.array(*[F.lit(x) for x in settings.languages]), F.array_position("post", F.col("best")).cast("int")
    )
    sure = enough & (F.col("best") >= settings.min_confidence)
    return judged.select(
        *[F.col(names[c]).alias(c) for c in kept if c.lower() not in results],
        F.when(sure, found).otherwise("und").alias("lang"),
        F.when(enough, F.col("best")).otherwise(F.lit(0.0)).alias("confidence"),
        "n_grams",
        F.when(enough, F.col("post")).alias("posterior"),
        sure.alias("lang_kept"),
    )


def keep_identified(docs: DataFrame, text: str, declared: str, address: str, model: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` whose language is identified, columns unchanged."""
    packed = fresh_name(docs.columns, "row")
    judged = identify(
        docs.withColumn(packed, F.struct(*[F.col(f"`{c}`") for c in docs.columns])),
        F.col(f"`{text}`"), F.col(f"`{declared}`"), F.col(f"`{address}`"), model, settings, keep=(packed,),
    )
    return judged.where("lang_kept").select(f"{packed}.*")
