"""The corpus pipeline: five operators in a row over ``documents``, each stage written as Parquet and read again.

What holds for every stage: null texts count as empty; long texts are read whole; rows that are repeated, or tie, get
equal answers each; an empty table gives an empty one with the same columns; other columns of ``docs`` stay as they
are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from extremes.llm import decontaminate, jaccard, langid, packing, quality
from extremes.llm.common import free_name, materialize, table

#: Least score at which a language is taken as known.
LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without letters, null and empty ones with them, and undecided ones go."""
    told = free_name(docs, "lang_id")
    found = langid.identify(docs, langid.train_on_documents(docs), out=told)
    return found.where((F.col(told)["lang_pred"] != langid.UNKNOWN) & (F.col(told)["score"] >= LANGUAGE_SCORE)).select(docs.columns)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not hold to be bad; empty texts are judged by their metadata as well."""
    judged = free_name(docs, "judged")
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.good())
    return quality.score(docs, model, out=judged).where(F.col(judged)["p_quality"] >= 0.5).select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id.

    Texts without words and rows without doc_id stay; rows that repeat a doc_id stay or go together.
    """
    return jaccard.keep_one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; empty texts hold none."""
    leaks = free_name(docs, "leaks")
    index = decontaminate.build(table(spark, sf_dir, "benchmark"))
    return decontaminate.find_leaks(docs, index, out=leaks).where(F.size(leaks) == 0).select(docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document, of length 0 for an empty text: its length bucket, its batch and its place in it."""
    return packing.pack(docs, packing.words())


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_batches),
]

#: The stages use trained models and a graph closure that SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
