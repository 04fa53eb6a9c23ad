"""Exact dedup by deterministic block naming.

Texts, without their blanks, are cut into blocks of a fixed size. Equal blocks get the same integer name, the row and
place of their first occurrence; then each pair of neighbours gets a name in the same way, round after round, until a
document has one name left. After k rounds names cover 2^k blocks, and a document leaves as soon as it has one name.

Names stand for contents, never for hashes, so the identity is free of collisions. Contents are shuffled once, to be
counted by hash and content; a hash that has one content only then stands for it, and the blocks of any other hash meet
by their contents.

Defined cases: null text is an empty text, and all empty texts are equal; of equal rows with the same doc_id one stays;
a null doc_id comes after all others; an empty table gives no rows; other columns are ignored. Rows are told apart by
their place in their file; what is no plain Parquet scan is written once for that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ROW, fresh, numbered, saved, spread_join, texts, written

BLOCK = 1024
BLANKS = b" \t\n\v\f\r"
#: A block's place: its row number times this, plus its own number; a text of 2 GiB has no more blocks.
PER_ROW = 1 << 21


def _place() -> Column:
    return (F.col("row") * F.lit(PER_ROW).cast("decimal(7,0)") + F.col("at")).cast(ROW)


def _code_points(x: bytes) -> int:
    return len(x) - int(np.count_nonzero((np.frombuffer(x, np.uint8) & 0xC0) == 0x80)) if not x.isascii() else len(x)


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, at, n, content, doc_id, size, sha) per block; the last three only with a text's first block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pick, at, n, content, first, size, sha = [], [], [], [], [], [], []
            for i, x in enumerate(texts(batch)):
                plain = x.translate(None, BLANKS)
                starts = range(0, max(1, len(plain)), block)
                pick += [i] * len(starts)
                at += range(len(starts))
                n += [len(starts)] * len(starts)
                content += [plain[s : s + block] for s in starts]
                first += [i] + [None] * (len(starts) - 1)
                size += [_code_points(x)] + [None] * (len(starts) - 1)
                sha += [hashlib.sha256(plain).hexdigest()] + [None] * (len(starts) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(pa.array(pick, pa.int64())), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(content, pa.binary()), batch.column(0).take(pa.array(first, pa.int64())), pa.array(size, pa.int64()), pa.array(sha, pa.string())],
                names=["row", "at", "n", "content", "doc_id", "size", "sha"],
            )

    return docs.mapInArrow(cut, f"row {ROW}, at long, n long, content binary, doc_id long, size long, sha string")


def identities(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(row, doc_id, size, sha, level, name) per row of ``docs`` (doc_id, text, row): equal (level, name), equal text; and the number of blocks."""
    cut = blocks(docs, block).withColumn("hash", F.xxhash64("content"))
    contents = cut.groupBy("hash", "content").agg(F.min(_place()).alias("name"), F.count("*").alias("times"))
    hashes = saved(contents.groupBy("hash").agg(F.min("name").alias("name"), F.sum("times").alias("times"), F.count("*").alias("contents")))
    columns = ["row", "at", "n", "name", "doc_id", "size", "sha"]
    total, mixed = hashes.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count_if(F.col("contents") > 1)).first()
    named = spread_join(cut.drop("content"), hashes.where("contents = 1"), ["hash"], "times", total).select(*columns)
    if mixed:  # different contents with one hash: a handful at any size
        shared = hashes.where("contents > 1").select("hash")
        named = named.unionByName(cut.join(contents.join(shared, "hash", "left_semi"), ["hash", "content"]).select(*columns))
    named = saved(named)
    heads = named.where("at = 0").select("row", "doc_id", "size", "sha", "n", "name")
    done = heads.where("n = 1").select("row", F.lit(0).alias("level"), "name")
    todo, level = named.where("n > 1").select("row", "at", "n", "name"), 0
    while not todo.isEmpty():  # as many rounds as the longest text has powers of two of blocks
        level += 1
        pairs = todo.groupBy("row", F.shiftright("at", 1).alias("at"), F.shiftright(F.col("n") + 1, 1).alias("n")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1).cast(ROW)).alias("right")
        )
        pairs = saved(pairs)
        names = pairs.groupBy("left", "right").agg(F.min(_place()).alias("name"), F.count("*").alias("times"))
        todo = saved(spread_join(pairs, names, ["left", "right"], "times", total).select("row", "at", "n", "name"))
        done = done.unionByName(todo.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        todo = todo.where("n > 1")
    long = done.where("level > 0").withColumnRenamed("level", "level_").withColumnRenamed("name", "name_")
    return heads.join(long, "row", "left").select("row", "doc_id", "size", "sha", F.coalesce("level_", F.lit(0)).alias("level"), F.coalesce("name_", "name").alias("name")), total


def duplicates(docs: DataFrame, block: int = BLOCK, row: str = "row") -> DataFrame:
    """Per row of ``docs`` (doc_id, text and a row number): row, doc_id, keep_id, group_size, kept, text_sha256."""
    known, total = identities(docs.select("doc_id", "text", F.col(row).cast(ROW).alias("row")), block)
    known = saved(known)
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row").alias("keep_row")))
    groups = known.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size"))
    return spread_join(known, groups, ["level", "name"], "group_size", total).select(
        "row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.keep_row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def find_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    return duplicates(numbered(docs, "row", "doc_id", "text"), block).drop("row")


def drop_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = fresh(docs, "row_")
    known = numbered(docs, row)
    goes = written(duplicates(known, block, row).where("not kept").select(F.col("row").alias(row)))
    return known.join(goes, row, "left_anti").drop(row)
