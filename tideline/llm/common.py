"""Helpers that several operators share: row numbers, checkpoints, Arrow batches cut by bytes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

#: A word is a run of anything but these six bytes, in every operator here.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python task works on at once.
CHUNK_BYTES = 1 << 20
BATCH_BYTES = "8m"
#: A row number: 40 bits for the place in a file, 64 for the file.
ROW = "decimal(38,0)"
PER_FILE = 1 << 40


def small_batches(spark: SparkSession) -> None:
    """Bound what an Arrow batch holds by bytes, so that long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, read from the session; only a local session without one gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tideline-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read from there ever after."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def swept(spark: SparkSession) -> None:
    """Collect the driver's garbage between the steps of a long query.

    The plans, jobs and task figures of finished steps go, so that the driver's heap does not grow with the number of steps;
    and Spark's cleaner deletes the shuffle files and checkpoints that only they held.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _is_scan(df: DataFrame) -> bool:
    return df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "row_index" in df.select(df.metadataColumn("_metadata").alias("m")).schema["m"].dataType.fieldNames()


def numbered(docs: DataFrame, name: str, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` (all, where none is named) plus ``name``, a row number that every later scan repeats.

    It is the row's place in its Parquet file, below a 64-bit hash of the file's path, so it hangs neither on how files are
    split nor on the executors there are. Anything but a plain Parquet scan is written once, and numbered as written.
    """
    chosen = columns or tuple(docs.columns)
    if not _is_scan(docs):
        docs = written(docs.select(*chosen))
    of = docs.metadataColumn("_metadata")
    number = F.xxhash64(of["file_path"]).cast(ROW) * F.lit(PER_FILE).cast("decimal(13,0)") + of["row_index"]
    return docs.select(*chosen, number.cast(ROW).alias(name))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int | None = None, salts: int = 64, shares: int = 1024) -> DataFrame:
    """Inner join of ``left`` with ``right``, in which ``count`` says how many rows of ``left`` have its keys.

    Keys with over 1/``shares`` of those rows, fewer than ``shares`` of them at any size, are broadcast to salt the left
    rows, and stand under each salt on the right; so the rows of one key meet in many tasks. ``total`` is the number of rows
    on the left, or more; without it ``right``, which should be saved then, is summed.
    """
    if total is None:
        total = right.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) > max(64, total // shares)
    salt = fresh(left.join(right, keys), "salt")
    marks = right.where(heavy).select(*keys, F.lit(salts).alias(salt)).distinct()
    salted = left.join(F.broadcast(marks), keys, "left").withColumn(salt, F.coalesce(F.pmod(F.hash(*[F.col(f.name) for f in left.schema if f.name not in keys and not isinstance(f.dataType, (ArrayType, MapType))]), F.col(salt)), F.lit(0)))
    every = F.when(heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn(salt, F.explode(every)), [*keys, salt]).drop(salt)


KNOWN_WORDS = 1_000_000


class Hashes(dict):
    """The hash of each word."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > KNOWN_WORDS:
            self.clear()
        h = self[word] = xxh64_intdigest(word, 42)
        return h


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A text column's UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``most`` bytes of text each (a longer text stands alone)."""
    for batch in batches:
        raw = texts(batch, column)
        start = size = 0
        for i, x in enumerate(raw):
            if size and size + len(x) > most:
                yield batch.slice(start, i - start), raw[start:i]
                start, size = i, 0
            size += len(x)
        if start < len(raw):
            yield batch.slice(start), raw[start:]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, most_bytes: int) -> pa.Table:
    """(text, y) of at most ``sample`` labelled documents of at most ``most_bytes`` bytes, none of them held out.

    The labels with the least hash of doc_id are chosen first, so only ``sample`` numbers are broadcast, and no text is
    shuffled but those chosen. Null labels, and doc_ids with both labels, do not count.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y1")).where("y = y1").select("doc_id", "y")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes)
    return short.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).select("text", "y").toArrow()
