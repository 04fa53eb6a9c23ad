"""Nearest neighbours by randomly rotated one-bit codes.

Equal vectors are searched once: a distinct vector stands with the eleven least ids of its copies, which is all that ten
neighbours can need. Distinct vectors are put into cells (centroids fitted on a bounded sample); what is left of a vector
after its cell's centroid is rotated at random, and the signs are its code, 64 of them in 8 bytes, beside two numbers: its
length and how far the code stands from it. A query is rotated the same way; code and numbers give an estimate of the inner
product with an error bound, and so a least distance. Only vectors whose least distance is within the query's limit are
reranked by their true distance, in double precision. The limit starts at the eleventh distance to the vectors of a bounded
sample, which the true one cannot exceed, and falls as vectors are reranked.

Every vector is indexed, and a query meets every cell that may hold a neighbour: a cell is left out only if its centroid's
distance less its radius is beyond the limit. Bounds of cells are exact; the error bound holds for all but about one in
a thousand vectors at the very limit (``ERRORS`` = 3), so recall is measured in tests, and is above 0.99.

Scale: cells of over ``SHARD`` vectors are split by hash, so a task holds one shard of vectors and one block of queries at a
time, each bounded, streamed from sorted rows; queries are sent to the shards they meet, vectors are shuffled twice. Of each
shard a query brings back eleven rows at most. Where vectors have no clusters all queries meet all shards, as they must:
the work then grows with queries times vectors, one bit a component.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, as candidates or
queries; vectors of different lengths do not meet; a null vec_id is a candidate, last among ties, and no query; a repeated
vec_id is a row each time, and a query drops one row with its own id and vector; fewer candidates give fewer rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import spread_join, written

NEAREST = 10
EVERY = 100
ERRORS = 3.0
SHARD = 1 << 16  #: vectors that a task holds at once
BLOCK = 4096  #: codes compared at once
QUERIES = 256  #: queries compared at once
PER_CELL = 1 << 14
MOST_CELLS = 1024
SAMPLE_PER_CELL = 32
SEEDS = 2048  #: vectors that give queries their first limit
PAIRS = 1 << 16  #: distances taken at once
NO_ID = (1 << 63) - 1  #: stands for a null vec_id, behind all others
ROUNDING = 1e-4  #: of a squared distance or a product, what single precision may lose


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(finite & F.exists(x, lambda v: v != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """Each distinct vector with the least ``most`` ids of its copies, null last: x, ids. Copies beyond are left before the shuffle."""
    ids = F.coalesce("vec_id", F.lit(NO_ID)).alias("id")
    first = rows.select("x", ids).withColumn("r", F.row_number().over(W.partitionBy("x").orderBy("id"))).where(F.col("r") <= most)
    return first.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def rotation(dims: int, seed: int = 13) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


class Space:
    """What tasks need to know of the vectors of one length: cells, their radii once known, the rotation and the sample."""

    def __init__(self, sample: np.ndarray, cells: int, rounds: int = 8):
        self.dims = sample.shape[1]
        self.scale = max(float(np.abs(sample).max()), 1e-300)
        self.turn = rotation(self.dims)
        self.seeds = sample[:SEEDS]
        x = sample / self.scale
        centers = x[:: max(1, len(x) // cells)][:cells].copy()
        for _ in range(rounds):
            of = self._nearest(x, centers)
            for k in np.unique(of):
                centers[k] = x[of == k].mean(axis=0)
        self.centers = centers * self.scale

    @staticmethod
    def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
        part = [((centers**2).sum(1) - 2 * (x[i : i + BLOCK] @ centers.T)).argmin(1) for i in range(0, len(x), BLOCK)]
        return np.concatenate(part) if part else np.empty(0, int)

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(x / self.scale, self.centers / self.scale)


def spaces(distinct: DataFrame, seed: int = 42) -> dict[int, Space]:
    """By length of vector. The sample are the distinct vectors with the least hash, 32 a cell and 32768 at the most."""
    sizes = {r.d: r.n for r in distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()}
    out = {}
    for d, n in sizes.items():
        cells = min(MOST_CELLS, -(-n // PER_CELL))
        rows = distinct.where(F.size("x") == d).orderBy(F.xxhash64(F.lit(seed), "x"), "x").limit(max(SEEDS, SAMPLE_PER_CELL * cells)).select("x").toArrow()
        out[d] = Space(np.array(rows.column("x").to_pylist(), dtype=np.float64), cells)
    return out


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = pc.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist():
        yield d, batch.filter(pa.array(lengths == d))


CODED = "d int, cell int, h long, x array<double>, ids array<long>, code binary, length double, fit double, away double"


def _code(known: dict[int, Space]):
    """Cell, code and numbers of each vector: the length of what is left of it, the code's inner product with it at length one,
    and its true distance from the centroid, for the cell's radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in by_length(batch):
                space, x = known[d], matrix(part, d)
                cell = space.cells_of(x)
                left = x - space.centers[cell]
                length = np.sqrt((left**2).sum(1))
                turned = (left / np.maximum(length, 1e-300)[:, None]) @ space.turn
                fit = np.abs(turned).sum(1) / np.sqrt(d)
                bits = np.packbits(turned > 0, axis=1)
                columns = [np.full(len(x), d), cell, part.column("h"), part.column("x"), part.column("ids"), [r.tobytes() for r in bits], length, fit, length]
                types = [pa.int32(), pa.int32(), pa.int64(), part.schema.field("x").type, part.schema.field("ids").type, pa.binary(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in CODED.split(", ")])

    return run


def encode(distinct: DataFrame, known: dict[int, Space]) -> DataFrame:
    """Every distinct vector with its cell and code, written once."""
    rows = distinct.select("x", "ids", F.xxhash64("x").alias("h"))
    return written(rows.mapInArrow(_code(known), CODED))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, added up component by component."""
    return np.sqrt(np.cumsum((x - q) ** 2, axis=1)[:, -1])


def limits(q: np.ndarray, space: Space, k: int) -> np.ndarray:
    """A distance within which each query has ``k`` distinct vectors, or infinity."""
    if len(space.seeds) < k:
        return np.full(len(q), np.inf)
    rough = (q**2).sum(1)[:, None] + (space.seeds**2).sum(1) - 2 * q @ space.seeds.T
    near = np.argpartition(rough, k - 1, axis=1)[:, :k]
    return np.stack([distances(space.seeds[near[:, i]], q) for i in range(k)], axis=1).max(1)


ROUTED = "d int, cell int, part int, x array<double>, most double"


def _route(known: dict[int, Space], cells: dict[int, list[tuple[int, float, int]]], k: int):
    """A query's row for each shard of each cell that may hold a neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, whole in by_length(batch):
                number, radius, parts = (np.array(c) for c in zip(*cells[d], strict=True))
                for at in range(0, whole.num_rows, 1024):
                    part = whole.slice(at, 1024)
                    q = matrix(part, d)
                    most = limits(q, known[d], k)
                    away = np.stack([distances(q, known[d].centers[c][None]) for c in number], axis=1)
                    i, j = np.nonzero(~(away - radius > most[:, None] * (1 + 1e-9) + 1e-300))
                    i, j = np.repeat(i, parts[j]), np.repeat(j, parts[j])
                    starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(i) else np.empty(0, int)
                    nth = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
                    columns = [pa.array(np.full(len(i), d), pa.int32()), pa.array(number[j], pa.int32()), pa.array(nth, pa.int32()), part.column("x").take(pa.array(i)), pa.array(most[i])]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROUTED.split(", ")])

    return run


FOUND = "x array<double>, score double, ids array<long>"


class Shard:
    """The vectors of one shard, and the search of a block of queries in them."""

    def __init__(self, space: Space, cell: int):
        self.space, self.center = space, space.centers[cell]
        self.batches: list[pa.RecordBatch] = []
        self.ready = False

    def close(self) -> None:
        table = pa.Table.from_batches(self.batches).combine_chunks().to_batches()[0]
        self.batches, self.ready = [], True
        self.x = matrix(table, self.space.dims)
        self.ids = table.column("ids")
        self.first = pc.list_element(self.ids, 0).to_numpy(zero_copy_only=False)
        self.length, self.fit = (table.column(c).to_numpy() for c in ("length", "fit"))
        self.code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(self.x), -1)

    def search(self, q: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, distance) of each query's ``k`` nearest in here, where within its limit."""
        d = self.space.dims
        left = q - self.center
        length = np.sqrt((left**2).sum(1))
        turned = ((left / np.maximum(length, 1e-300)[:, None]) @ self.space.turn).astype(np.float32)
        best = (np.empty(0, int), np.empty(0, int), np.empty(0))
        for at in range(0, len(self.x), BLOCK):
            own = slice(at, at + BLOCK)
            signs = np.unpackbits(self.code[own], axis=1, count=d).astype(np.float32) * 2 - 1
            fit, size = np.maximum(self.fit[own], 1e-12), self.length[own]
            product = (turned @ signs.T) / np.sqrt(d) / fit
            error = ERRORS * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(1, d - 1)) + ROUNDING
            square = length[:, None] ** 2 + size**2
            least = square - 2 * length[:, None] * size * (product + error) - ROUNDING * square
            i, j = np.nonzero(~(least > most[:, None] ** 2))  # what overflowed is no bound
            true = np.concatenate([distances(self.x[own][j[s : s + PAIRS]], q[i[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)]) if len(i) else np.empty(0)
            within = true <= most[i]
            best = tuple(np.concatenate([a, b]) for a, b in zip(best, (i[within], j[within] + at, true[within]), strict=True))
            best, most = self._nearest(best, most, k)
        return best

    def _nearest(self, best: tuple, most: np.ndarray, k: int) -> tuple[tuple, np.ndarray]:
        """The first ``k`` of each query by distance and then by least id; the last of them is its new limit."""
        order = np.lexsort((self.first[best[1]], best[2], best[0]))
        i, j, true = (x[order] for x in best)
        start = np.searchsorted(i, np.arange(len(most)))
        rank = np.arange(len(i)) - start[i]
        most = most.copy()
        full = rank == k - 1
        most[i[full]] = np.minimum(most[i[full]], true[full])
        keep = rank < k
        return (i[keep], j[keep], true[keep]), most


def _search(known: dict[int, Space], k: int):
    """Rows sorted by length, cell, part and kind: a shard's vectors, then the queries that meet it, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("d", "cell", "part", "kind")], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True]).tolist()
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                d, cell, part, kind = keys[s].tolist()
                if at != (d, cell, part):
                    at, shard = (d, cell, part), Shard(known[d], cell)
                rows = batch.slice(s, e - s)
                if kind == 0:
                    shard.batches.append(rows)
                    continue
                if not shard.ready:
                    if not shard.batches:
                        continue
                    shard.close()
                for low in range(0, rows.num_rows, QUERIES):
                    block = rows.slice(low, QUERIES)
                    i, j, true = shard.search(matrix(block, d), block.column("most").to_numpy(), k)
                    columns = [block.column("x").take(pa.array(i)), pa.array(true), shard.ids.take(pa.array(j))]
                    yield pa.RecordBatch.from_arrays(columns, names=["x", "score", "ids"])

    return run


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """Per query and neighbour: query_id, rank, vec_id, score. Queries are the vectors whose vec_id ``every`` divides."""
    rows = sound(vectors)
    distinct = written(distinct_vectors(rows, k + 1))
    known = spaces(distinct)
    coded = encode(distinct, known)
    held = coded.groupBy("d", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()
    cells: dict[int, list] = {d: [] for d in known}
    for r in held:
        cells[r.d].append((r.cell, r.radius * (1 + 1e-9), -(-r.n // SHARD)))
    parts = F.create_map(*[F.lit(v) for r in held for v in (f"{r.d}:{r.cell}", -(-r.n // SHARD))]) if held else F.create_map(F.lit(""), F.lit(1))
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = written(queries.groupBy("x").agg(F.count("*").alias("times")))
    routed = asked.select("x").mapInArrow(_route(known, cells, k + 1), ROUTED).withColumn("kind", F.lit(1))
    part = F.pmod(F.shiftright("h", 20), parts[F.concat_ws(":", "d", "cell")].cast("long")).cast("int")
    shards = coded.select("d", "cell", part.alias("part"), "x", "ids", "code", "length", "fit", F.lit(0).alias("kind"))
    both = shards.unionByName(routed, allowMissingColumns=True)
    sorted_rows = both.repartition("d", "cell", "part").sortWithinPartitions("d", "cell", "part", "kind")
    found = sorted_rows.mapInArrow(_search(known, k + 1), FOUND)
    each = found.select("x", "score", F.explode("ids").alias("id"))
    first = each.withColumn("r", F.row_number().over(W.partitionBy("x").orderBy("score", "id"))).where(F.col("r") <= k + 1)
    lists = written(first.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near")).join(asked, "x"))
    own = F.array_position(F.transform("near", lambda n: n["id"]), F.col("vec_id"))
    at = F.when((own > 0) & (F.get(F.col("near"), own.cast("int") - 1)["score"] == 0), own)
    joined = spread_join(queries, lists, ["x"], "times")
    trimmed = F.slice(F.when(at.isNull(), F.col("near")).otherwise(F.filter("near", lambda _, i: i + 1 != at)), 1, k)
    rank = joined.select(F.col("vec_id").alias("query_id"), F.posexplode(trimmed).alias("r", "n"))
    return rank.select("query_id", (F.col("r") + 1).alias("rank"), F.nullif(F.col("n.id"), F.lit(NO_ID)).alias("vec_id"), F.col("n.score").alias("score"))
