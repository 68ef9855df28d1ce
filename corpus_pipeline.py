"""From raw documents to packed training sequences: five stages, each one operator of ``furrow.llm``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import language_id, line_dedup, packing, quality, simhash
from furrow.llm.texts import documents, staged

#: Least pooled probability of a language; with four languages an even guess is 0.25.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays open."""
    found = language_id.identify(docs)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are robust outliers of their language and source."""
    return quality.quality_rules(docs).where("kept").select("row.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays, ``n_chars`` follows its text."""
    found = line_dedup.drop_lines(docs, limit=10, least=1)
    fields = {c: F.col(f"carried.`{c}`") for c in docs.columns if c != "text"}
    fields |= {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast("long")} if "n_chars" in docs.columns else {})
    return found.select(*[fields[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.one_per_group(docs, shingle=4, distance=4)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality_filter),
    ("lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

#: Language and quality rest on a trained network and iterated estimates, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read back as the next one's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
