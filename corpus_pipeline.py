"""Corpus pipeline: quality classifier, exact dedup, near dedup, mixing, packing, each stage written before the next.

The stages before the last return the columns of ``documents``. Stages 1 to 3 drop rows, stage 4 drops and repeats rows
by source, stage 5 returns the packed pieces. Columns beside those of ``documents``, with whatever names, pass through the
first four stages; an empty table gives an empty result in each. What a stage makes of nulls, empty and very long texts,
ties and repeated rows stands with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import op2_mixing, op3_packing, op5_exact, op7_jaccard, op8_quality
from tideline.llm.common import removed, shared_folder, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Null and empty texts are scored by the bias; equal texts stay or go alike, and all
    their rows with them; without labels of both classes every document stays."""
    small_batches(spark)
    return op8_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for blanks: the longest, then the least doc_id, null last, then the
    first in its file. Null and empty texts are one group."""
    small_batches(spark)
    return op5_exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts with a Jaccard similarity of 0.8 or more in runs of five words: the least doc_id,
    null last, then the first in its file. Null and empty texts are one component; a text is read whole, however long."""
    small_batches(spark)
    return op7_jaccard.keep_unlike(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says. A null source is one, a text without words has no size but the same
    draw; rows with one doc_id, or none, share a draw; a mixture without any word is empty."""
    return op2_mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places. Null and empty texts are the end id alone; each row is packed."""
    import public_tokenizers

    small_batches(spark)
    return op3_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("mixing sources", mixing), ("best-fit packing", packing)]
#: A trained model, fingerprints and a tokenizer take part: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet in the shared folder and read again.

    A stage's input is removed once its result is written, so that two copies stand at most; the last one stays.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            removed(spark, f"{base}/{k - 1}")
    return docs
