"""Centroid clustering in JVM expressions only.

A vector is put on an integer grid, floor(1024 * x). Each round is one aggregation: ``zip_with`` and ``aggregate`` give the
squared distances to the centroids, which are literal arrays, ``array_min`` over structs of (distance, number) chooses
the cluster, and one sum a component, partial before the shuffle, moves the centroids. A round shuffles at most 8 rows a
task and brings 8 to the driver, whatever the number of vectors; a cluster that holds most rows costs no more than others.
Vectors are read anew in each round and not stored: the grid is cheaper than a copy.

Defined cases: vectors that are null, of another length than ``dims`` or with a null or non-finite component are left out;
fewer vectors than clusters give fewer clusters, none an empty result; a repeated row is a row; a null vec_id may not
seed while others can; rows with one vec_id seed in the order of their components. Components beyond 2^27 on the grid are
worked in decimals and clamped at 2^53; a distance or an inertia beyond 64 bits is given as 2^63 - 1. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLUSTERS = 8
ROUNDS = 10
DIMS = 64
GRID = 1024
#: Up to here on the grid a squared distance of 64 components fits 64 bits.
NARROW = 1 << 27
WIDEST = 1 << 53
LARGEST = (1 << 63) - 1
WIDE = "decimal(38,0)"


def on_grid(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, q) of the vectors that take part, q as whole numbers."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * GRID, F.lit(float(WIDEST))), F.lit(float(-WIDEST)))))
    return vectors.where((F.size("embedding") == dims) & sound).select("vec_id", q.alias("q"))


def seeds(grid: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """The vectors with the least hash of vec_id, in that order."""
    h = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return [list(r.q) for r in grid.select(h.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(clusters).collect()]


def typed(grid: DataFrame, kind: str) -> DataFrame:
    """The grid with its components as ``kind``, and the sum of their squares."""
    rows = grid.withColumn("q", F.col("q").cast(f"array<{kind}>"))
    return rows.withColumn("square", F.expr(f"aggregate(q, cast(0 as {kind}), (s, x) -> cast(s + x * x as {kind}))"))


def nearest(centroids: list[list[int]], kind: str) -> Column:
    """The least struct of (distance, cluster) of a ``typed`` row.

    The distance is taken as q^2 + c^2 - (q * 2c), which is exact on whole numbers and less work than squares of
    differences. It is put together as SQL text, which is ten times as quick to build as 512 literals one by one.
    """

    def to(number: int, centroid: list[int]) -> str:
        doubled = f"cast(array({', '.join(f'{2 * c}BD' for c in centroid)}) as array<{kind}>)"
        own = f"cast(square + {sum(c * c for c in centroid)}BD as {kind})"
        return f"struct(aggregate(zip_with(q, {doubled}, (a, b) -> cast(a * b as {kind})), {own}, (s, x) -> cast(s - x as {kind})) as distance, {number} as cluster)"

    return F.expr(f"array_min(array({', '.join(to(i, c) for i, c in enumerate(centroids))}))")


def fit(grid: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[list[list[int]], str]:
    """The centroids after all rounds, and the type that distances need."""
    centroids = seeds(grid, clusters)
    if not centroids:
        return [], "bigint"
    dims = len(centroids[0])
    widest = grid.agg(F.max(F.array_max(F.transform("q", F.abs)))).first()[0] or 0
    kind = "bigint" if widest <= NARROW else WIDE
    rows = typed(grid.select("q"), kind)
    for _ in range(rounds):
        chosen = rows.select("q", nearest(centroids, kind)["cluster"].alias("cluster"))
        sums = chosen.groupBy("cluster").agg(F.count("*").alias("n"), *[F.expr(f"sum(q[{i}]) as s{i}") for i in range(dims)])
        for r in sums.collect():
            centroids[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
    return centroids, kind


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    grid = on_grid(vectors, dims)
    centroids, kind = fit(grid, clusters, rounds)
    long = lambda c: F.least(c, F.lit(LARGEST)).cast("long")
    if not centroids:
        none = F.lit(None)
        return grid.select("vec_id", none.cast("int").alias("cluster"), *[none.cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], none.cast("string").alias("centroid_sha256"))
    best = typed(grid, kind).select("vec_id", nearest(centroids, kind).alias("best")).select("vec_id", "best.cluster", "best.distance")
    sums = {r.cluster: int(r.s) for r in best.groupBy("cluster").agg(F.sum(F.col("distance").cast(WIDE)).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return best.select(
        "vec_id",
        "cluster",
        long(F.col("distance")).alias("distance"),
        of([min(sums.get(i, 0), LARGEST) for i in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), LARGEST)).cast("long").alias("inertia"),
        of(names).alias("centroid_sha256"),
    )
