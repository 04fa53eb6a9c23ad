"""Near dedup of whole texts at a Jaccard similarity of word shingles, by SimHash first and exactly in the end.

At a similarity of 0.8 some ten of 64 fingerprint bits differ, which no cut into segments that differ in one bit at most
can index: it would need seven segments of nine bits. So the deletion variants of ``op7_simhash`` propose what is within
their two bits, which joins most members of large groups of copies, and a prefix filter finds every other pair: with
the shingles of all texts in one fixed order, two sets of n and m shingles that are similar enough share one of their
first n - ceil(similar * n) + 1 (and m alike). The order is by frequency, common ones last, so that passages which many
texts share are in few prefixes. The frequencies are counts over all texts in 2^32 counters, dealt over the tasks;
the ``COMMON`` highest are broadcast, all other shingles count as rare and are ordered by their hash. Any fixed order
gives the same result. Every proposed pair is checked by the two whole sets.

A shingle whose prefix list has over ``NEAR`` + 1 nodes is crowded. There each node first meets only the ``CHAIN`` before it;
the links that this gives are joined, and then each node that is not in the crowd's largest component meets the nodes
of other components. So no pair is lost, and no group of copies is paired out.

Before texts are read for it, a pair has to pass two bounds that no similar pair fails: on the sizes, and on the
difference of the sets, which is at least the number of bits in which ``BITS`` parities of their hashes differ.

Defined cases: null and empty texts are alike, and like nothing else; a text of fewer words than a shingle is one
shingle; of a component the row with the least doc_id stays, null reached last; an empty table gives no rows; all columns
are kept. Texts with equal sets of shingles (64-bit hashes) are one node.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import ROW, Hashes, chunks, fresh, numbered, saved, written
from tideline.llm.op7_simhash import links

SEED = 42
WIDTH = 5
SIMILAR = 0.8
NEAR, CHAIN = 16, 4
BITS = 1024
PARITY = [f"p{k}" for k in range(BITS // 64)]
COMMON, COMMON_FROM = 1 << 20, 17
RANGES, RANGE_BITS = 4096, 20  #: the 2^32 counters, as ranges that a task counts one after another
JUMP = (1 << 16) - 1
LINKS = 1 << 18  #: links that a task follows at once
AT_ONCE = 4_000_000  #: shingles sorted at once before they are sent to the ranges
EPS = 1e-9
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, hashes: Hashes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` words, mixed from the words' own."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    h = np.fromiter(map(hashes.__getitem__, words), dtype="<u8", count=len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    g = h[:n].copy()
    for k in range(1, width):
        g = (g * ODD) ^ (h[k : k + n] + (g >> np.uint64(29)))
    return np.unique(g ^ (g >> np.uint64(32)))


def parities(h: np.ndarray) -> np.ndarray:
    """Whether an odd number of the hashes falls on each of ``BITS`` places, as longs."""
    odd = np.bincount((h & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def simhash(h: np.ndarray) -> int:
    """Majority bits of the set, as a signed long."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 255):  # sums of bytes, wide enough for 255 rows
        ones += np.unpackbits(h[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def name_of(h: np.ndarray) -> int:
    """The set's own hash, as a signed long."""
    from xxhash import xxh64_intdigest

    name = xxh64_intdigest(h.tobytes(), SEED)
    return name - (1 << 64) if name >> 63 else name


def prefix_length(n: int, similar: float) -> int:
    return n - int(np.ceil(similar * n - EPS)) + 1 if n else 0


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest 32 bits of the most frequent shingles, sorted, and how many texts hold them (8 MB at the most)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = Hashes(), [], 0

        def out() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held))
            part = values >> np.uint32(RANGE_BITS)
            gaps = np.diff(values & np.uint32((1 << RANGE_BITS) - 1), prepend=np.uint32(0)).astype(np.int64)
            first = np.flatnonzero(np.diff(part, prepend=np.uint32(RANGES)))
            gaps[first] = values[first] & np.uint32((1 << RANGE_BITS) - 1)
            jumps = gaps // JUMP  # a gap is so many jumps, and the rest
            told = np.full(len(gaps) + int(jumps.sum()), JUMP, dtype="<u2")
            told[np.cumsum(jumps + 1) - 1] = gaps % JUMP
            ends = np.cumsum(jumps + 1)[np.append(first[1:], len(values)) - 1]
            cuts = pa.py_buffer((2 * np.concatenate([[0], ends])).astype(np.int32))
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, cuts, pa.py_buffer(told)])
            return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), blobs], names=["part", "held"])

        for _, raw in chunks(batches):
            for x in raw:
                held.append((shingles(x, hashes, width) >> np.uint64(32)).astype("<u4"))
                n += len(held[-1])
                if n >= AT_ONCE:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = -1, np.zeros(1 << RANGE_BITS, dtype=np.uint32)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(counts >= COMMON_FROM)
            return pa.RecordBatch.from_arrays([pa.array((at + (part << RANGE_BITS)).astype("<u4").view("<i4")), pa.array(np.minimum(counts[at], (1 << 31) - 1).astype("<i4"))], names=["shingle", "n"])

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != part:
                    if part >= 0:
                        yield out()
                    part = k
                    counts[:] = 0
                gaps = np.frombuffer(x, "<u2")
                np.add.at(counts, np.cumsum(gaps, dtype=np.int64)[gaps != JUMP], 1)
        if part >= 0:
            yield out()

    dealt = docs.select("text").mapInArrow(deal, "part int, held binary")
    counted = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(count, "shingle int, n int")
    top = counted.orderBy(F.col("n").desc(), "shingle").limit(COMMON).toArrow()
    value, n = top.column("shingle").to_numpy().view(np.uint32), top.column("n").to_numpy()
    order = np.argsort(value)
    return value[order], n[order]


def first_shingles(h: np.ndarray, common: tuple[np.ndarray, np.ndarray], similar: float) -> np.ndarray:
    """The set's prefix in the order of (frequency among the common ones, hash)."""
    value, n = common
    p = prefix_length(len(h), similar)
    if not len(value) or not p:
        return h[:p]
    top = (h >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(value, top), len(value) - 1)
    often = value[at] == top
    rare = h[~often]
    if len(rare) >= p:
        return rare[:p]
    more, weight = h[often], n[at[often]]
    return np.concatenate([rare, more[np.lexsort((more, weight))[: p - len(rare)]]])


def shingle_sets(docs: DataFrame, row: str, width: int) -> DataFrame:
    """(doc_id, row, node, n, fp, parities): the node names the set of n shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch, raw in chunks(batches):
            sets = [shingles(x, hashes, width) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(map(name_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(simhash, sets), pa.int64()), *(pa.array(np.ascontiguousarray(p)) for p in np.stack(list(map(parities, sets))).T)], names=["doc_id", "row", "node", "n", "fp", *PARITY])

    kept = docs.select("text", "doc_id", F.col(row).alias("row"))
    doc_id = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(rows, f"doc_id {doc_id}, row {ROW}, node long, n long, fp long, {', '.join(f'{c} long' for c in PARITY)}")


def prefixes(docs: DataFrame, shared: Broadcast, width: int, similar: float) -> DataFrame:
    """(key, node): the shingles of each set's prefix, by the broadcast common ones; a set that comes again in a task is told once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, told = Hashes(), set()
        for _, raw in chunks(batches):
            keys, nodes = [], []
            for x in raw:
                h = shingles(x, hashes, width)
                node = name_of(h)
                if node not in told:
                    told.add(node)
                    keys.append(first_shingles(h, shared.value, similar))
                    nodes.append(node)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(nodes, dtype=np.int64), [len(k) for k in keys]))], names=["key", "node"])

    return docs.select("text").mapInArrow(rows, "key long, node long")


def shared_prefixes(keys: DataFrame) -> DataFrame:
    """The rows of (key, node), each once, whose key has two nodes or more; ``crowded`` where it has over ``NEAR`` + 1."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, v, sent = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0  # the last key's rows, and how many of it were sent: none until it is crowded

        def out(most: int, sizes: np.ndarray) -> pa.RecordBatch:
            met = sizes[:most] > 1
            return pa.RecordBatch.from_arrays([pa.array(k[:most][met]), pa.array(v[:most][met]), pa.array(sizes[:most][met] > NEAR + 1)], names=["key", "node", "crowded"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, v = np.concatenate([k, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()])
            once = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
            k, v = k[once], v[once]
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            of_key = np.diff(starts, append=len(k))
            sizes = np.repeat(of_key + np.where(starts == 0, sent, 0), of_key)
            keep = 1 if sizes[-1] > NEAR + 1 else of_key[-1]
            yield out(len(k) - keep, sizes)
            k, v, sent = k[-keep:], v[-keep:], sizes[-1] - keep
        if len(k):
            yield out(len(k), np.full(len(k), len(k) + sent))

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(rows, "key long, node long, crowded boolean")


def meetings(shared: DataFrame) -> DataFrame:
    """(a, b), which may come again: each two nodes of a key at most ``NEAR`` apart in the order of nodes, or ``CHAIN`` where it is crowded, a < b."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = v = np.zeros(0, dtype=np.int64)
        c = np.zeros(0, dtype=bool)
        for batch in batches:
            old = len(k)
            k, v = np.concatenate([k, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()])
            c = np.concatenate([c, batch.column(2).to_numpy(zero_copy_only=False)])
            for lag in range(1, NEAR + 1):
                i = np.arange(max(old, lag), len(k))
                i = i[k[i] == k[i - lag]]
                if lag > CHAIN:
                    i = i[~c[i]]
                if not len(i):
                    break
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(v[i], v[i - lag])), pa.array(np.maximum(v[i], v[i - lag]))], names=["a", "b"])
            k, v, c = k[-NEAR:], v[-NEAR:], c[-NEAR:]

    return shared.repartition("key").sortWithinPartitions("key", "node").mapInArrow(rows, "a long, b long")


def _may_be_alike(a: str, b: str, similar: float) -> Column:
    """The bounds on sizes and on the difference, of columns that end in ``a`` and in ``b``."""
    x, y = F.col(f"n{a}"), F.col(f"n{b}")
    differ = reduce(operator.add, [F.bit_count(F.col(f"{c}{a}").bitwiseXOR(F.col(f"{c}{b}"))) for c in PARITY])
    return (F.least(x, y) >= F.greatest(x, y) * similar - EPS) & (differ <= (x + y) * ((1 - similar) / (1 + similar)) + EPS)


def _of(nodes: DataFrame, name: str, end: str, *more: str) -> DataFrame:
    """(node as ``name``, n, fp and parities), with ``end`` behind their names."""
    return nodes.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}{end}") for c in ("n", *more, *PARITY)))


def alike(pairs: DataFrame, rows: DataFrame, row: str, nodes: DataFrame, width: int, similar: float) -> DataFrame:
    """(a, b): the pairs whose sets have the similarity, by their whole texts."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch, raw in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(map(zip_.compress, raw), pa.binary())], names=["node", "held"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unzip = Hashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (shingles(unzip.decompress(t.as_py()), hashes, width) for t in (x, y))
                met = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(met >= similar * (len(x) + len(y) - met) - EPS)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    found = written(nodes.join(asked, "node").select("node", F.col("best.row").alias(row)))
    held = saved(rows.select(row, "text").join(found, row).select("text", "node").mapInArrow(packed, "node long, held binary"))
    a, b = held.select(F.col("node").alias("a"), F.col("held").alias("x")), held.select(F.col("node").alias("b"), F.col("held").alias("y"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) that the deletion variants of SimHash propose: nodes of one fingerprint, and of two that link, by their least nodes."""
    of = saved(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.where("n > 0").join(of, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    linked = links(of.select("fp"))
    for s in "ab":
        linked = linked.join(of.select(F.col("fp").alias(s), F.col("first").alias(f"first_{s}")), s)
    return same.unionByName(linked.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b) and, for each, the least one that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (differ := root[x] != root[y]).any():
        p, q = root[x[differ]], root[y[differ]]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (to := root[root] != root).any():
            root[to] = root[root[to]]
    return nodes, nodes[root]


def reach(pairs: DataFrame, most: int = LINKS) -> DataFrame:
    """(fp, root) for each node of the links (a, b) but the least of its component, which is its root. ``pairs`` should be saved.

    A round deals the links by their larger node to tasks of about ``most``; each task points its nodes at the least that its own
    links reach. One task is then done; of several, each pointer jumps to where its target points, and the next round starts.
    Links so shorten by half, and what points to two nodes makes them meet in its task.
    """

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
        if held:
            nodes, roots = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
            far = nodes != roots
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(roots[far]), pa.array(np.full(int(far.sum()), part))], names=["fp", "root", "part"])

    edges = pairs.select(F.greatest("a", "b").alias("fp"), F.least("a", "b").alias("root"))
    while True:
        state = saved(edges.repartition(edges.count() // most + 1, "fp").mapInArrow(point, "fp long, root long, part long"))
        if state.agg(F.min("part") == F.max("part")).first()[0] is not False:
            return state.select("fp", "root")
        best = saved(state.groupBy("fp").agg(F.min("root").alias("root"), F.max("root").alias("other")))
        to = best.select(F.col("fp").alias("root"), F.col("root").alias("jump"))
        jumped = saved(state.select("fp", "root").join(to, "root", "left").select("fp", "jump", F.coalesce("jump", "root").alias("root")).distinct())
        if best.where("root != other").isEmpty() and jumped.where("jump is not null").isEmpty():
            return best.select("fp", "root")
        edges = jumped.select("fp", "root")


def _roots(df: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    return df.join(roots.select(F.col("fp").alias(node), F.col("root").alias("root_")), node, "left").withColumn(root, F.coalesce("root_", node)).drop("root_")


def crowded_pairs(crowd: DataFrame, nodes: DataFrame, roots: DataFrame, similar: float) -> DataFrame:
    """(a, b) of crowded shingles, which may come again: each node outside a crowd's largest component with the nodes of other components."""
    members = saved(_roots(crowd, roots, "node", "root"))
    parts = members.groupBy("key", "root").agg(F.count("*").alias("nodes"))
    largest = parts.groupBy("key").agg(F.max_by("root", F.struct("nodes", "root")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    inside = members.join(largest.drop("parts"), "key")
    few = inside.where("root != largest").select("key", F.col("node").alias("a"), F.col("root").alias("root_a")).join(_of(nodes, "a", "_a"), "a")
    every = inside.select("key", F.col("node").alias("b"), F.col("root").alias("root_b")).join(_of(nodes, "b", "_b"), "b")
    met = few.join(every, (few["key"] == every["key"]) & (F.col("root_a") != F.col("root_b")) & _may_be_alike("_a", "_b", similar))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def keep_unlike(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """One row of each component of similar texts, the one with the least doc_id, with all columns of ``docs``."""
    row = fresh(docs, "row_")
    rows = numbered(docs, row)
    known = saved(shingle_sets(rows, row, width))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    nodes = saved(known.groupBy("node").agg(best, *(F.first(c).alias(c) for c in ("n", "fp", *PARITY))))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, width))
    shared = saved(shared_prefixes(prefixes(rows, common, width, similar)))
    common.destroy()
    pairs = meetings(shared).withColumn("close", F.lit(False)).unionByName(fingerprint_pairs(nodes).withColumn("close", F.lit(True)))
    near = pairs.groupBy("a", "b").agg(F.max("close").alias("close"))
    near = near.join(_of(nodes, "a", "_a", "fp"), "a").join(_of(nodes, "b", "_b", "fp"), "b").where(_may_be_alike("_a", "_b", similar))
    near = near.select("a", "b", "close", F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))).alias("d"))
    # The nearest node of each first, and what SimHash proposes: where all are alike, these few links already join them.
    nearest = F.row_number().over(Window.partitionBy("b").orderBy("d", "a")) == 1
    near = saved(near.select("a", "b", (nearest | F.col("close")).alias("first")))
    linked = saved(alike(near.where("first"), rows, row, nodes, width, similar))
    roots = reach(linked)
    apart = _roots(_roots(near, roots, "a", "root_a"), roots, "b", "root_b").where("root_a != root_b").select("a", "b", "first")
    more = saved(crowded_pairs(shared.where("crowded").select("key", "node"), nodes, roots, similar))
    rest = apart.unionByName(more.withColumn("first", F.lit(False))).groupBy("a", "b").agg(F.max("first").alias("first"))
    rest = saved(rest.where("not first").select("a", "b"))
    if not rest.isEmpty():
        joined = roots.select(F.col("root").alias("a"), F.col("fp").alias("b"))
        roots = reach(saved(joined.unionByName(alike(rest, rows, row, nodes, width, similar))))
    part = saved(_roots(nodes.select("node", "best"), roots, "node", "root"))
    stays = part.groupBy("root").agg(F.min("best").alias("stay")).select("root", F.col("stay.row").alias("stay"))
    found = known.select("node", "row").join(part.select("node", "root").join(stays, "root"), "node")
    goes = written(found.where("row != stay").select(F.col("row").alias(row)))
    return rows.join(goes, row, "left_anti").drop(row)
