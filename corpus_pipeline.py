"""Cleaning and packing a corpus: four stages, each written as Parquet and read again as the next one's documents.

Defined results: without labels of both classes no document is rejected; null and empty texts are scored as texts without
words, link with nothing, and are packed as their closing id alone if they stay; rows that repeat an id and its text stay as one,
rows that repeat an id with other texts are documents of their own, and null ids stay, each row by itself; of linked
documents the smallest id stays, whatever the order of rows; texts of any length are taken whole; other columns go
along, whatever their names, up to the packing, which returns pieces; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import jaccard, packing, quality, toxicity
from lexispark.llm.common import forget, saved, table

#: Near-duplicates: five words to a shingle, a similarity of 0.8 or more.
NEAR = jaccard.Params(words=5, num=80, den=100)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labelled documents."""
    model = quality.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def harmless_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; it learns from all labelled documents."""
    model = toxicity.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_harmless(docs, model)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, and all that link with nothing."""
    return jaccard.representatives(docs, NEAR)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(packing.DEFAULT_VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality", good_documents), ("toxicity", harmless_documents), ("near-duplicates", distinct_documents), ("packing", packed)]

#: Trained classifiers and token ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return docs
