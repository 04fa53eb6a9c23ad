"""A snapshot in hash buckets of job_uid, of which a cycle writes only what came.

Below the store's folder stand

    rows/cycle=<n>/bucket=<b>   rows that cycle n wrote of a bucket
    passes/cycle=<n>            the sources that succeeded in n: source, exhaustive, as_of
    manifest/cycle=<n>          per bucket the cycles whose rows hold it, oldest first, and how many rows each has

A cycle reads the buckets that its postings fall into, merges them, and writes the merged rows of the postings that came.
Of a uid the row of the newest cycle counts. Rows of a bucket from several cycles are folded into one when the older ones
are not more than twice the newer: so a row is written again about as often as the bucket has doubled, a bucket is in few
pieces, and what a cycle writes follows its batch and not the snapshot. Aging writes nothing: a row's status is worked out
on reading, from the passes since it was last seen. The manifest is written last; a cycle that has one is not run again,
and one that broke off is written anew. Folders that no kept manifest names are removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.identity import collapse
from tideline.operators.snapshot import aged_by, merge_came
from tideline.plans.config import Feed
from tideline.schemas import SNAPSHOT, SNAPSHOT_COLUMNS

Parts = list[tuple[int, int]]  #: (cycle, rows), oldest first
#: An older piece is folded with the newer ones if it has at most so many times their rows.
FOLD = 2
MANIFEST = "bucket INT, parts ARRAY<STRUCT<cycle: BIGINT, n: BIGINT>>"
PASSES = "source STRING, exhaustive BOOLEAN, as_of TIMESTAMP, cycle BIGINT"


def folded(parts: Parts, cycle: int, came: int) -> tuple[Parts, Parts]:
    """The pieces that stay as they are, and those that are folded into what the cycle writes."""
    total, at = came, len(parts)
    while at and parts[at - 1][1] <= FOLD * total:
        at -= 1
        total += parts[at][1]
    return parts[:at], parts[at:]


@dataclass
class Store:
    spark: SparkSession
    path: str
    feed: Feed
    buckets: int = 64
    keep: int = 2

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, fs = self._fs(path)
        return fs.exists(at)

    def _remove(self, path: str) -> None:
        at, fs = self._fs(path)
        fs.delete(at, True)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("job_uid"), F.lit(self.buckets)).cast("int")

    def done(self, cycle: int) -> bool:
        return self._exists(f"{self.path}/manifest/cycle={cycle}/_SUCCESS")

    def last(self) -> int | None:
        """The newest cycle with a manifest."""
        at, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(at):
            return None
        cycles = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if s.isDirectory()]
        return max((c for c in cycles if self.done(c)), default=None)

    def manifest(self, cycle: int | None) -> dict[int, Parts]:
        """The pieces of each bucket; there are at most as many rows as buckets."""
        if cycle is None:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/cycle={cycle}").collect()
        return {r.bucket: [(p.cycle, p.n) for p in r.parts] for r in rows}

    def _pieces(self, of: dict[int, Parts]) -> DataFrame:
        """All rows of the pieces, with the uid's older ones."""
        paths = [f"{self.path}/rows/cycle={c}/bucket={b}" for b, parts in of.items() for c, _ in parts]
        return self.spark.read.schema(SNAPSHOT).parquet(*paths) if paths else self.spark.createDataFrame([], SNAPSHOT)

    def _newest(self, of: dict[int, Parts]) -> DataFrame:
        """One row a uid. A bucket in one piece has no others and is not shuffled."""
        whole, several = ({b: p for b, p in of.items() if (len(p) > 1) == many} for many in (False, True))
        if not several:
            return self._pieces(whole)
        row = F.max_by(F.struct(*[c for c in SNAPSHOT_COLUMNS if c != "job_uid"]), "last_seen_cycle").alias("row")
        newest = self._pieces(several).groupBy("job_uid").agg(row).select("job_uid", "row.*").select(*SNAPSHOT_COLUMNS)
        return self._pieces(whole).unionByName(newest) if whole else newest

    def merge(self, batch: DataFrame, passes: DataFrame, cycle: int, as_of: Column, order: list[str]) -> None:
        """Merge a cycle's kept postings; ``passes`` is (source, exhaustive), one row per source that succeeded."""
        if self.done(cycle):
            return
        previous = self.last()
        before = self.manifest(previous)
        came = collapse(batch, order).persist()
        try:
            arrived = {r.bucket: r.n for r in came.groupBy(self.bucket().alias("bucket")).agg(F.count("*").alias("n")).collect()}
            plan = {b: folded(before.get(b, []), cycle, n) for b, n in arrived.items()}
            merged = merge_came(self._newest({b: before[b] for b in arrived if b in before}), came, cycle, as_of, self.feed.announce_crosslisted)
            old = {b: fold for b, (_, fold) in plan.items() if fold}
            if old:
                merged = merged.unionByName(self._newest(old).join(came.select("job_uid"), "job_uid", "left_anti").select(*SNAPSHOT_COLUMNS))
            rows = f"{self.path}/rows/cycle={cycle}"
            merged.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(rows)
            passes.select("source", F.coalesce("exhaustive", F.lit(True)).alias("exhaustive"), as_of.alias("as_of")).write.mode("overwrite").parquet(f"{self.path}/passes/cycle={cycle}")
        finally:
            came.unpersist()
        wrote = {}
        if arrived:
            wrote = {r.bucket: r.n for r in self.spark.read.parquet(rows).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        after = before | {b: [*stays, (cycle, wrote[b])] for b, (stays, _) in plan.items()}
        made = self.spark.createDataFrame([(b, parts) for b, parts in sorted(after.items())], MANIFEST)
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/cycle={cycle}")
        self._forget(cycle, after)

    def _forget(self, cycle: int, newest: dict[int, Parts]) -> None:
        """Remove what only manifests name that are not kept any more."""
        at, fs = self._fs(f"{self.path}/manifest")
        cycles = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if s.isDirectory())
        kept = [c for c in cycles if c <= cycle][-self.keep :]
        named = {(b, c) for k in kept for b, parts in (newest if k == cycle else self.manifest(k)).items() for c, _ in parts}
        for old in [c for c in cycles if c < kept[0]]:
            for b, parts in self.manifest(old).items():
                for c, _ in parts:
                    if (b, c) not in named:
                        self._remove(f"{self.path}/rows/cycle={c}/bucket={b}")
            self._remove(f"{self.path}/manifest/cycle={old}")

    def passes(self, cycle: int) -> DataFrame:
        """(source, exhaustive, as_of, cycle) of all passes up to a cycle."""
        return self.spark.read.schema(PASSES).option("basePath", f"{self.path}/passes").parquet(f"{self.path}/passes").where(F.col("cycle") <= cycle)

    def read(self, cycle: int | None = None) -> DataFrame:
        """The snapshot after a cycle that is kept (the last one, if not named), as if each pass had aged it."""
        cycle = self.last() if cycle is None else cycle
        if cycle is None:
            return self.spark.createDataFrame([], SNAPSHOT)
        return aged_by(self._newest(self.manifest(cycle)), self.passes(cycle), self.feed)


#: From a landed batch and its cycle to (kept postings, passes, as_of).
Prepare = Callable[[DataFrame, int], tuple[DataFrame, DataFrame, Column]]


def ingest_into(store: Store, source: DataFrame, checkpoint: str, prepare: Prepare, order: list[str]) -> DataFrame:
    """Run what has landed on the stream ``source`` through the store, one cycle a batch, from 1 on, and return the snapshot."""

    def one(batch: DataFrame, number: int) -> None:
        cycle = number + 1
        if not store.done(cycle):
            postings, passes, as_of = prepare(batch, cycle)
            store.merge(postings, passes, cycle, as_of, order)

    query = source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(one).start()
    query.awaitTermination()
    return store.read()
