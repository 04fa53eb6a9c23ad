"""SimHash near-dedup with deletion-variant signatures.

Fingerprints that differ in at most two bits agree, in one of their two halves, but for at most one bit. So each
distinct fingerprint is indexed under either half with each one of its 32 bits left out, fingerprints with an equal
signature are joined, and the join verifies the whole distance. A signature that many fingerprints have is not joined:
its fingerprints are signed again by the parts of their other half (16 bits, then 8), under the same argument, until a
signature fixes 53 of 64 bits. No candidate is dropped, and no more than ``most`` fingerprints meet under a signature,
but for the last level, where 2048 are all there can be.

Linked fingerprints then take, round after round, the least doc_id that they can reach.

Defined cases: null or empty text has fingerprint zero, which links like any other; repeated rows and equal texts share
one fingerprint and so a component; a null doc_id is reached last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fresh, numbered, saved, spread_join, texts, written

SEED = 42
SHINGLE = 3
DISTANCE = 2
MOST = 256
STEP = 200_000  #: shingles hashed at once


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    ones = np.zeros(64, dtype=np.int64)
    n = len(words) - width + 1
    for at in range(0, n, STEP):
        part = words[at : at + STEP + width - 1]
        grams = map(b" ".join, zip(*(part[k : len(part) - width + 1 + k] for k in range(width)), strict=True))
        h = np.fromiter((xxh64_intdigest(g, seed) for g in grams), dtype="<u8", count=len(part) - width + 1)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of bytes, wide enough for 255 rows
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: str, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, *more, fp) with the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, width, seed) for x in texts(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], names=[*batch.schema.names[1:], "fp"])

    kept = docs.select("text", "doc_id", *more)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(rows, f"{schema}, fp long")


#: Widths of the parts at each level: 2 * 32 bits, then the other half as 2 * 16, then its other half as 2 * 8.
WIDTHS = (32, 16, 8)


def _signed(level: DataFrame, width: int, first: bool) -> DataFrame:
    """Signatures of (fp, key, sub, must, free): 2 * width rows each.

    key and sub are the signature; must are the left-out bits in which a pair has to differ, so that a pair with equal
    parts is seen once and not under each left-out bit; free is where the bits begin that no signature has fixed yet.
    """
    rows = level.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("bit"))
    part = f"(shiftrightunsigned(fp, free + side * {width}) & {(1 << width) - 1}L & ~shiftleft(1L, bit))"
    packed = f"(shiftleft(cast(side * {width} + bit as bigint), {width}) | {part})"
    bits = width + width.bit_length()
    return rows.select(
        "fp",
        F.expr(packed if first else "key").alias("key"),
        F.expr("sub" if first else f"shiftleft(sub, {bits}) | {packed}").alias("sub"),
        F.expr(f"must | if(bit > 0, shiftleft(1L, free + side * {width} + bit), 0L)").alias("must"),
        F.expr(f"free + (1 - side) * {width}").alias("free"),
    )


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b) for each two of the distinct ``fps`` (fp) at a distance from 1 to 2; a < b as signed numbers."""
    level = fps.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("sub"), F.lit(0).cast("long").alias("must"), F.lit(0).alias("free"))
    found = []
    for depth, width in enumerate(WIDTHS):
        signed = _signed(level, width, depth == 0)
        met = saved(signed.groupBy("key", "sub").agg(F.count("*").alias("n")).where("n > 1"))
        last = depth + 1 == len(WIDTHS)
        few = met if last else met.where(F.col("n") <= most)
        near = saved(signed.join(few.select("key", "sub"), ["key", "sub"], "left_semi").select("key", "sub", "fp", "must"))
        a, b = near.withColumnRenamed("fp", "a"), near.select("key", "sub", F.col("fp").alias("b"))
        differ = F.col("a").bitwiseXOR(F.col("b"))
        found.append(a.join(b, ["key", "sub"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= DISTANCE) & (differ.bitwiseAND(F.col("must")) == F.col("must"))).select("a", "b"))
        many = met.where(F.col("n") > most).select("key", "sub")
        if last or many.isEmpty():
            break
        level = saved(signed.join(many, ["key", "sub"], "left_semi"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, label, root): the least label among those that links reach, and the fp that names the component.

    ``nodes`` is (fp, label), ``pairs`` (a, b) links. Labels may repeat, as those of rows without a doc_id do; roots do not.

    Each round a node takes the least label of itself, its neighbours and, as labels name nodes, the label of the node
    that it points to; chains so shorten by half a round.
    """
    both = saved(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    linked = both.select(F.col("a").alias("fp")).distinct()
    state = saved(linked.join(nodes, "fp").select("fp", F.struct("label", "fp").alias("root")))
    while True:
        near = both.join(state.select(F.col("fp").alias("b"), "root"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("near"))
        stepped = state.join(near, "fp").select("fp", "root", F.least("root", "near").alias("next"))
        to = state.select(F.col("fp").alias("to"), F.col("root").alias("jump"))
        stepped = saved(stepped.withColumn("to", F.col("next.fp")).join(to, "to").select("fp", "root", F.least("next", "jump").alias("next")))
        if stepped.where("root != next").isEmpty():
            return stepped.select("fp", F.col("next.label").alias("label"), F.col("next.fp").alias("root"))
        state = stepped.select("fp", F.col("next").alias("root"))


def near_duplicates(docs: DataFrame, *more: str, most: int = MOST) -> DataFrame:
    """Per document: doc_id, ``more``, fp, root, which is one fp of the component, and component_id, the least doc_id that links reach."""
    known = saved(fingerprints(docs, *more))
    nodes = saved(known.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1)).alias("label"), F.count("*").alias("times")))
    merged = components(nodes.select("fp", "label"), saved(links(nodes.select("fp"), most))).withColumnRenamed("label", "merged")
    final = nodes.join(merged, "fp", "left").select("fp", "times", F.coalesce("root", "fp").alias("root"), F.coalesce("merged", "label").alias("component_id"))
    final = final.withColumn("component_id", F.when(F.col("component_id") < (1 << 63) - 1, F.col("component_id")))
    return spread_join(known, saved(final), ["fp"], "times").select(*known.columns, "root", "component_id")


def keep_one(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One row of each component, the one with the least doc_id, with all columns of ``docs``."""
    row = fresh(docs, "row_")
    rows = numbered(docs, row)
    known = near_duplicates(rows, row, most=most)
    stays = known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))).alias("best")).select(F.col(f"best.{row}").alias(row))
    return rows.join(written(stays), row, "left_semi").drop(row)
