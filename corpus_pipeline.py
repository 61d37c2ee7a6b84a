"""The corpus pipeline: documents pass five stages, each stored before the next.

Every stage works on all rows that its predecessor kept. Quality rules drop documents,
near-duplicate detection leaves one document of each group, repeated strings are cut out of
the texts (n_chars follows), documents with benchmark passages go, and the rest is mixed to
target weights. The last stage adds each row's weight and probability.

Each stage treats nulls, empty and long texts, repeated rows and empty tables as its
operator in ledgerlens.llm says.
"""

from __future__ import annotations

import os
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, mixing, near_duplicates, quality_rules, repeats
from ledgerlens.llm.common import drop_staged, stage, staged_paths

REPEATED_WORDS = 50


def _sweeping(step):
    """Of the tables that a stage staged, those its result does not read are removed at once; nothing is kept between calls."""

    @wraps(step)
    def swept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with staged_paths() as paths:
            result = step(spark, docs, sf_dir)
        read = result.inputFiles()
        drop_staged(spark, [path for path in paths if not any(os.path.basename(path) in file for file in read)])
        return result

    return swept


@_sweeping
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    return quality_rules.kept_documents(docs)


@_sweeping
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8)."""
    return near_duplicates.kept_documents(docs)


@_sweeping
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that stand more than once."""
    cut = repeats.remove_repeats(docs, length=REPEATED_WORDS, words=True, carried=[c for c in docs.columns if c != "text"])
    n_chars = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.char_length("kept_text")).cast(docs.schema["n_chars"].dataType)
    cut = cut.select("row.*", F.col("kept_text").alias("text"), n_chars.alias("new_n_chars")).drop("n_chars").withColumnRenamed("new_n_chars", "n_chars")
    return cut.select(*docs.columns)


@_sweeping
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of any benchmark item."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_sweeping
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and classes of length (the tables name no topic) have the target shares."""
    return mixing.mix(docs).filter("selected").select("row.*", "weight", "probability")


STAGES = [
    ("quality rules", quality), ("near-duplicates", one_of_each_group), ("repeated strings", without_repeats), ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
]
ORACLE_SQL = None  # string repeats and raking have no reasonable SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
