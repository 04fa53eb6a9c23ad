"""Late postings on a stream: what is older than the newest by more than an age is dropped, and so is its state.

The age is the delay of the watermark on ``posted_at``: a batch's postings are measured by the newest of the batches before.
A uid's state, which keeps its repeats out, goes when no posting of its date could pass any more, so state is bounded by the
postings of one age and not by the stream. Postings without a date pass and have no state; their repeats meet in the snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def recent(postings: DataFrame, max_age_days: int) -> DataFrame:
    """The postings of a stream of (job_uid, posted_at, ...) that are recent or undated, each dated uid once."""
    dated = postings.where(F.col("posted_at").isNotNull()).withWatermark("posted_at", f"{max_age_days} days").dropDuplicatesWithinWatermark(["job_uid"])
    return dated.unionByName(postings.where(F.col("posted_at").isNull()))


def appended(rows: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Run what has landed, each batch into a folder of its own, which a repeated batch writes anew. Returns the finished query."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = rows.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(one).start()
    query.awaitTermination()
    return query


def written_batches(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All batches so far, with their number as ``batch``."""
    return spark.read.schema(f"{schema}, batch BIGINT").option("basePath", out).parquet(out)
