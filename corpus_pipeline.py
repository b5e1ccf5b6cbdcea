"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all
but the last return the columns of documents.  Null and repeated ids, null, empty and
very long texts, ties, empty tables and further columns are taken as the operators'
docstrings say: such rows go through unless they are toxic, equal or nearly equal to
another one, or not taken by the mix.  No SQL is given for the whole, as the
first stage is a trained classifier; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from tidemark.llm.shared import discard, load, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labelled ones, does not predict to be toxic."""
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked near duplicates: that with the smallest id."""
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document, and of what they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:  # nothing reads the stage before any more
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
