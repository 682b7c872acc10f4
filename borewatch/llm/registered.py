"""The queries of the operators, and the SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borewatch.llm import (
    language, mixing, negatives, packing, prefixes, quality_model, quality_rules, secrets, sharding, simhash, toxicity,
    urls, vectors,
)
from borewatch.llm.common import table
from borewatch.llm.oracles import ORACLES  # noqa: F401

TOKENIZER = "word_bpe_49k.json"


def op1_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.assess(table(spark, folder, "documents"))


def op3_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_shards(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shards(table(spark, folder, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op10_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer=public_tokenizers.path(TOKENIZER))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = table(spark, folder, "embeddings").select(
        "vec_id", negatives.relabelled(vec_id, label).alias("label"),
        negatives.scaled(F.col("embedding")).alias("vector"),
    )
    return negatives.mine(rows, anchors=vec_id % 100 == 0)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefixes.rebuilt(table(spark, folder, "conversations"))
    return prefixes.trie(turns)


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix, op2_quality_rules, op3_quality_model, op4_shards, op5_vectors, op6_urls, op7_toxicity, op8_language,
        op9_simhash, op10_pack, op11_hard_negatives, op12_prefix_trie, op13_secrets,
    )
}
