"""Training-data pipeline over ``documents``: stages applied in order, each one's result written and read again.

Language ID drops texts without a letter and those whose language is too uncertain; exact dedup keeps one of equal
texts; the n-gram join keeps one document of each group of near duplicates (five-word shingles, Jaccard
similarity of 0.8 or more); mixing draws documents by temperature weights, some more than once; packing lays
out what was drawn. All but the last return the columns of the documents they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.llm import exact_dedup, language_id, mixing, ngram_join, packing
from volpanel.llm.tables import stage, table

#: Least calibrated score of a language for a document to stay.
MIN_LANGUAGE_SCORE = 0.5
#: SQL can't train the classifier, so the stages are tested against brute-force versions.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; text that is null or has no letter is rejected."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.accept(docs, model, MIN_LANGUAGE_SCORE)


def exact_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text; half of the ids are the stored snapshot, the others the incoming batch."""
    return exact_dedup.keep_one(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; rows without a shingle stay."""
    return ngram_join.keep_one(docs, join=ngram_join.Join(words=5, num=80, den=100))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture draws them."""
    return mixing.draw(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its bin, the bin's length, and the place in it."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", exact_deduplicated),
    ("ngram_join", near_deduplicated),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
