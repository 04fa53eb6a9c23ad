"""Mixing sources to target weights.

Tokens are summed per source, a source's rate is its target over its size, and each document is taken
floor(rate) times plus once more when a number hashed from its doc_id falls below the fraction.

The table of sources has one small row per source; it is ranked and levelled in one window, counted, and broadcast back
to the documents, or joined with frequent sources salted where there are very many sources. Defined cases: null text has size 0; a null source is a source of its own, last in order; repeated rows share
one draw; an empty table gives no rows; a mixture without any word takes no copies of anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import WORD, fresh, saved, spread_join

WEIGHTS = (1, 2, 3)
MOST = 3  #: no source is taken more often than this
MOST_BROADCAST = 100_000  #: sources whose table is broadcast, some 10 MB; beyond, the join is spread


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the doc_id and the seed."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Targets are min(level * weight, most * size) with the level that makes them add up to all sizes. In order of
    most * size / weight the sources at their limit come first, so the level is that of the first source which,
    with all before it at their limit, stays below its own; from there on the quotient falls, so it is the largest.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_limit = W.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole, before = by_limit.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), by_limit.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    found = (
        sizes.withColumn("weight", weight.cast("double"))
        .withColumn("limit", (F.col("source_size") * most).cast("double"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(whole))
    )
    return found.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("limit")), F.col("limit")).alias("target"))


def source_rates(docs: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target, rate, rows), saved: one row per source."""
    sums = docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"), F.count("*").alias("rows"))
    sums = saved(sums)
    targets = source_targets(sums.select("source", "source_size"), weights, most).join(sums.select(F.col("source").alias("_source"), "rows"), F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return saved(targets.select("source", "source_size", "target", rate.alias("rate"), "rows"))


def with_rates(docs: DataFrame, rates: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``docs`` with columns of their source's row, under the names given; texts are not shuffled where the sources are few."""
    key, rows = fresh(docs, "key_"), fresh(docs, "rows_")
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(key)
    small = rates.select(named(F.col("source")), F.col("rows").alias(rows), *[F.col(c).alias(new) for c, new in columns.items()])
    left = docs.withColumn(key, named(F.col("source")))
    joined = left.join(F.broadcast(small), key) if rates.count() <= MOST_BROADCAST else spread_join(left, small, [key], rows)
    return joined.drop(key, rows)


def copies(doc_id: Column, rate: Column, seed: int) -> Column:
    return F.floor(rate) + (draw(doc_id, seed) < rate - F.floor(rate)).cast("long")


def plan_mixture(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate and copies (how often to take it)."""
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    joined = with_rates(sized, source_rates(docs, weights, most), {c: c for c in ("source_size", "target", "rate")})
    return joined.select("doc_id", "source", "size", "source_size", "target", "rate", copies(F.col("doc_id"), F.col("rate"), seed).alias("copies"))


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mixture, each row as often as it is taken, with the input's columns."""
    rate, copy = fresh(docs, "rate_"), fresh(docs, "copy_")
    joined = with_rates(docs, source_rates(docs, weights, most), {"rate": rate})
    taken = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies(F.col("doc_id"), F.col(rate), seed).cast("int"))))
    return taken.select(*docs.columns)
