"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source; row r of a source of n rows stands at (r + 1/2) / n; all rows
in the order of that fraction are cut into shards whose counts differ by one at most. Any stretch of that order, and so
every shard, holds each source in its share.

Both ranks are made of a count of what comes before a row's bucket and a rank within the bucket. Buckets are equal
stretches of the hash or of the fraction, so they stay even however large a source is. A source has about a million
buckets at the most, as their counts are summed in one window a source.

The law is ``rows``. Groups of equal texts are not kept together: a row's shard hangs on its rank among its source's rows
alone, and a shard that took a group whole could neither have its count of rows nor its share of each source.

Defined cases: null text has size 1 and the checksum of an empty text; a null source is a source; repeated rows each
get a slot; an empty table gives no rows; fewer rows than shards leave shards empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import fresh, numbered, saved, spread_join

SHARDS = 16
ROWS_PER_BUCKET = 2000  #: or a millionth of all rows, if that is more
TOP = float(1 << 52)


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their rank, from 0, in each group; ``bucket`` has to follow the order."""
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = W.partitionBy(*group, bucket).orderBy(*order)
    return rows.withColumn("r", F.row_number().over(within) - 1).join(counts, [*group, bucket]).withColumn(name, (F.col("r") + F.col("base")).cast("long")).drop("r", "base")


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = 42, row: str | None = None) -> DataFrame:
    """Per row: doc_id, source, size, text_crc32, law, shard, slot, grown_shard; and the number of the row, under ``row``, if given."""
    more = [row] if row else []
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text).alias("h"),
        *more,
    )
    rows = saved(rows.withColumn("u", F.shiftrightunsigned("h", 12).cast("double") / TOP))
    sizes = saved(rows.groupBy("source").agg(F.count("*").alias("of_source")))
    n = sizes.agg(F.sum("of_source")).first()[0] or 0
    per = max(ROWS_PER_BUCKET, n >> 20)
    rows = spread_join(rows, sizes, ["source"], "of_source", n)
    rows = rows.withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col("of_source") / per)).cast("long"))
    rows = _ranked(rows, ["source"], "bucket", [F.col("u"), F.col("h"), F.col("doc_id"), *more], "rank").drop("bucket")
    rows = rows.withColumn("fraction", (F.col("rank") + 0.5) / F.col("of_source"))
    rows = rows.withColumn("bucket", F.floor(F.col("fraction") * max(1, -(-n // per))).cast("long")).withColumn("all", F.lit(0))
    place = _ranked(rows, ["all"], "bucket", [F.col("fraction"), F.col("source"), F.col("rank")], "place")
    shard = F.floor(F.expr(f"cast(place as decimal(38,0)) * {shards}L div {max(1, n)}L")).cast("int")
    start = F.expr(f"cast((cast(shard as bigint) * {n}L + {shards - 1}L) div {shards}L as bigint)")
    return place.withColumn("shard", shard).select(
        "doc_id",
        F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - start).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *more,
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 42, files_per_shard: int = 1) -> None:
    """Write ``docs`` as Parquet under shard=0, shard=1, ..., each file a run of slots, in order."""
    row, shard, slot = (fresh(docs, c) for c in ("row_", "shard", "slot_"))
    rows = numbered(docs, row)
    places = assign(rows, shards, seed, row).select(row, F.col("shard").alias(shard), F.col("slot").alias(slot))
    placed = rows.join(places, row).drop(row)
    placed.repartitionByRange(shards * files_per_shard, shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)
