"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import op1_secrets, op2_mixing, op3_packing, op4_chat, op5_exact, op6_rules, op7_simhash, op8_quality, op9_repeats, op10_sharding, op11_centroids, op12_alignment, op13_neighbours
from tideline.llm.common import small_batches, table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return op1_secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = op2_mixing.plan_mixture(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return op3_packing.pack(table(spark, sf_dir, "documents"), _tokenizer())


def op4_chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return op4_chat.read_back(op4_chat.windows(turns.unionByName(extra)))


def op5_exact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return op5_exact.find_duplicates(table(spark, sf_dir, "documents"))


def op6_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return op6_rules.check_rules(docs, op6_rules.fit(docs, table(spark, sf_dir, "labels")))


def op7_simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = op7_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return op8_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repeats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return op9_repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_sharding.assign(table(spark, sf_dir, "documents")).drop("source")


def op11_centroids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return op12_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_neighbours_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return op13_neighbours.nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets_query,
        "op2_mixing": op2_mixing_query,
        "op3_packing": op3_packing_query,
        "op4_chat": op4_chat_query,
        "op5_exact": op5_exact_query,
        "op6_rules": op6_rules_query,
        "op7_simhash": op7_simhash_query,
        "op8_quality": op8_quality_query,
        "op9_repeats": op9_repeats_query,
        "op10_sharding": op10_sharding_query,
        "op11_centroids": op11_centroids_query,
        "op12_alignment": op12_alignment_query,
        "op13_neighbours": op13_neighbours_query,
    }
