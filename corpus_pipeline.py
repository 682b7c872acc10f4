"""Preparation of a training corpus: quality rules, toxicity, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; `run` writes each stage's rows
and reads them again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from borewatch.llm import mixing, packing, quality_rules, simhash, toxicity
from borewatch.llm.common import materialise, table

#: The toxicity model, the components and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stand near their language's histograms."""
    return quality_rules.kept(docs)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the labels are those of the corpus."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def by_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicated(docs)


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences."""
    return packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", by_quality_rules),
    ("toxicity", by_toxicity),
    ("near-duplicates", by_near_duplicates),
    ("mixture", by_mixture),
    ("packing", into_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
