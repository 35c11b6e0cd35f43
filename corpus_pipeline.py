"""From raw documents to packed token sequences: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs.  All but the last return the columns of `documents`.

A document's id and its text decide; repeated rows, null ids and null texts are handled as the operators
say.  Language identification drops null texts and texts without a letter, exact deduplication keeps the
largest doc_id of equal texts, near-duplicates keep the smallest doc_id of a group, mixing repeats rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ductlake.llm import exact_dedup, language, mixing, packing, simhash
from ductlake.llm.queries import remainder, table, tokenizer_file
from ductlake.llm.work import keep


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, or all if none is labelled; null texts and texts without a letter go."""
    model = language.fit(docs.where(F.coalesce(remainder(5) != 0, F.lit(True))))
    if model is None:
        return language.with_letters(docs)
    whole = docs.select(F.struct("*").alias("row_"), "text")
    return language.identify_languages(whole, model).where(F.col("lang_pred") != language.UNKNOWN).select("row_.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.first_of_equal(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    return simhash.first_of_groups(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, shuffled."""
    whole = docs.select(F.struct("*").alias("row_"), "doc_id", "text", "source")
    return mixing.mix_sources(whole).select("row_.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of a document in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs


# Tokenizers, fingerprints and cross-parsing are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None
