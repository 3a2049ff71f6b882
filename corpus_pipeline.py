"""The corpus pipeline: quality rules, language, near duplicates, packing.

Each stage takes what its predecessor kept and returns the columns of `documents`; the
last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.llm import jaccard, langid, packing, quality
from flowsift.llm.common import store, table
from flowsift.llm.queries import TOKENIZER


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words and compression ratios pass."""
    return quality.keep_quality(docs, "text")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified from text, declaration and source."""
    settings = langid.Settings()
    model = langid.fit_text_model(docs, "text", "lang", settings)
    return langid.keep_identified(docs, "text", "lang", "source", model, settings)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word windows, similarity 0.8."""
    return jaccard.keep_representatives(docs, "doc_id", "text")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces of sequences of 2048 tokens, with their ids."""
    packed = packing.pack(docs, "doc_id", "text", TOKENIZER)
    return packed.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", keep_good),
    ("language ID", keep_known_language),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("packing", pack_tokens),
]

#: Compression ratios, text likelihoods and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = store(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
