"""A training corpus from raw documents: toxic texts go, of exact copies one stays, of near copies one stays, texts that hold
passages of the test items go, and what is left is packed into sequences.

Each stage takes (spark, docs, folder of the tables) and works on all that its predecessor kept; all but the last return the
columns of ``documents``. Defined cases are those of the stages' operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuslink.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from corpuslink.session import frozen, tuned

# Learning, and the choice among near copies, cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by a grammar learnt from the labelled ones among them (never from held-out ids)."""
    labels = tuned(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.not_toxic(docs, toxicity.fit(toxicity.labelled(docs, labels)))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the longest, then of smallest id."""
    tuned(spark)
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a Jaccard similarity of 0.8 over five-word shingles the one of smallest id."""
    tuned(spark)
    return ngram_join.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a test item occurs."""
    items = tuned(spark).read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.without_hits(docs, items, "documents")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    tuned(spark)
    return packing.packed(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("exact dedup", copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", leaks),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
