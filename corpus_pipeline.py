"""From raw documents to packed sequences: language, quality, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet in the
shared folder and hands it, read again, to the next. All but the last stage keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actlake.llm import jaccard, langid, mixing, packing, quality
from actlake.llm.common import read, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the model is fitted to their own labels, but for the held-out ones."""
    return langid.keep_identified(docs, langid.fit_languages(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, by a network fitted to the labels of those that are not held out."""
    return quality.keep_good(docs, quality.fit_quality(docs, read(spark, sf_dir, "labels")))


# near copies: sets of shingles of five words with a Jaccard similarity of at least 0.8 (op2 has values of its own)
NEAR_WORDS, NEAR_PERCENT = 5, 80


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of smallest id, and all documents that have none."""
    return jaccard.keep_one_row(docs, NEAR_PERCENT, NEAR_WORDS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the sources' target shares; a row occurs as often as the mix takes it."""
    return mixing.whole_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that make up the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identified),
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("mixing to target weights", mixed),
    ("packing", packed),
]

# The language and quality stages are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"llm-pipeline-{number}")
    return docs
