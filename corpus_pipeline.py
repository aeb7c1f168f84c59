"""A corpus pipeline: five stages, each on all that the one before kept, written between as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearway.llm import language, minhash_dedup, mixing, packing, secrets
from nearway.llm.common import Workspace, table, unwrapped
from nearway.llm.queries import tokenizer_path

#: A document is rejected if its language can't be told: no letter, or less than this probability for the best.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with that language; the network learns from docs' own labels.

    Null texts and texts without a letter go, and those of which the network is not sure enough. Documents without an id,
    repeated rows and very long texts are judged as any other; where no row is labelled, nothing can be told and all go.
    """
    told = language.identify(docs, with_row=True).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return told.select(*unwrapped(docs, lang=F.col("lang_pred")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id.

    Rows that share an id but no text stay each, rows without an id come last in their class, of repeated rows one stays,
    and texts without words are no duplicates of each other.
    """
    return minhash_dedup.drop_near_duplicates(docs, similarity=0.8, shingle=5)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; null and empty texts and texts without one stay as they are."""
    return secrets.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last copy cut; documents without words go, a null source is one."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens; each repeated row is packed."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", known_language), ("near duplicates", distinct_texts), ("secrets", without_secrets), ("mixing", mixed_sources), ("packing", packed)]

#: The stages learn a network and hash shingles, which SQL can't express; tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        before, docs = docs, work.write(made)
        if k:
            work.drop(before)
    return docs
