"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm.decontaminate import without_copies
from notemill.llm.langid import in_known_language, language_samples
from notemill.llm.near_dup import one_of_each_group
from notemill.llm.packing import pack_documents
from notemill.llm.substring_dedup import remove_duplicate_spans
from notemill.staging import stage, unstage

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the labelled ones; those that are null, have no letter or are in none of these languages go."""
    return in_known_language(docs, language_samples(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id (null last); one of equal rows.

    Groups are those of ``near_duplicates``: fingerprints of five-word shingles, linked
    at four or fewer differing bits. All null ids of one group count as one document.
    """
    return one_of_each_group(docs, shingle=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document (by id) already has; ``n_chars``, if there, follows the text."""
    cut = remove_duplicate_spans(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item, whatever their ids."""
    return without_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages: a row per piece of each document that is left, with its place in a sequence.

    Each stage is written as Parquet and read again. Null texts, texts without a letter and
    texts in none of the labelled languages go with the first stage; an empty table gives an empty one; columns that
    are not known to a stage pass it as they are, whatever their names.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, apply) in enumerate(STAGES[:-1]):
        done = stage(apply(spark, docs, sf_dir), name)
        if k:  # the stage before is read no more
            unstage(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
