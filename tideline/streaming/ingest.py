"""Cycles from landed files by Structured Streaming: each batch is merged into the newest snapshot, which is written whole.

For snapshots of any kind that are small enough for that; ``store`` keeps large ones of postings. The last two stay.

Repeats are met by the snapshot, not by stream state, so a batch of any size or age may come again: a batch id that has
its snapshot is skipped. No watermark: late rows and rows without a date are kept, as in a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Merge = Callable[[DataFrame | None, DataFrame, int], DataFrame]


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _done(spark: SparkSession, path: str) -> bool:
    at, fs = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def ingest(source: DataFrame, out: str, checkpoint: str, merge: Merge) -> DataFrame:
    """Run what has landed through ``merge(snapshot or None, batch, cycle)`` and return the last snapshot.

    Snapshots stand at ``out``/cycle=<n>; a cycle that was written but not yet noted by the stream is taken as it is.
    """
    spark = source.sparkSession
    last: list[str] = []

    def one(batch: DataFrame, cycle: int) -> None:
        path, before = f"{out}/cycle={cycle}", f"{out}/cycle={cycle - 1}"
        if not _done(spark, path):
            session = batch.sparkSession
            snapshot = session.read.parquet(before) if cycle else None
            merge(snapshot, batch, cycle).write.mode("overwrite").parquet(path)
            at, fs = _folder(spark, f"{out}/cycle={cycle - 2}")
            fs.delete(at, True)
        last.append(path)

    query = source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(one).start()
    query.awaitTermination()
    if not last:
        at, fs = _folder(spark, out)
        cycles = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at)]
        last.append(f"{out}/cycle={max(c for c in cycles if _done(spark, f'{out}/cycle={c}'))}")
    return spark.read.parquet(last[-1])
