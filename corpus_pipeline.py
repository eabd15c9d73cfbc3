"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet, and the next stage reads that. All but the last return the columns of
documents; the last returns the mixture, a row for each copy of a document with
its shard and its position in the shard.

Nulls, empty texts, ties and repeated rows are what the operators say: a text
without a letter has no language and goes; of equal texts the one with the most
code points stays; an empty table stays empty through all stages. Texts count
whole however long they are. Further columns go through all stages as they are,
whatever their names; only the last stage replaces those named copy, shard or
position, and leaves out those named like a result of ``mixing.draws``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import common, decontaminate, exact_dedup, langid, mixing, near_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on 5-word shingles."""
    return near_dedup.keep_one(docs, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: a row for each copy."""
    return mixing.mixture(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("mix", mix)]

#: Naive Bayes, signatures and alignments are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
