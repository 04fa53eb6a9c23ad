"""Operators on vectors against plain versions over lists."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from tideline.llm import op11_centroids, op13_neighbours

SCHEMA = "vec_id long, embedding array<double>, distance string, cluster string, q int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def edges(dims=64, n=60):
    """Ordinary vectors, ties, copies, repeated rows and ids, and every kind of vector that takes no part."""
    draw = random.Random(5)
    of = lambda: [draw.uniform(-1, 1) for _ in range(dims)]
    rows = [(i, of()) for i in range(n)]
    same = of()
    rows += [(i, same) for i in range(n, n + 40)] + [(0, rows[0][1]), (7, of()), (None, of()), (None, same)]
    rows += [(900, [0.0] * dims), (901, None), (902, []), (903, of()[:-1]), (904, [None] + of()[1:]), (905, [math.nan] + of()[1:]), (906, of()[:-1] + [math.inf]), (907, [-0.0] * dims)]
    return [(i, v, "x", "y", 1) for i, v in rows]


def plain_clusters(rows, clusters=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (sha(f"3:{r[0]}"), r[1])) + sorted(r for r in kept if r[0] is None)
    centers = [list(q) for _, q in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(centers)) for _, q in kept]

    for _ in range(rounds):
        best = assign()
        for k in range(len(centers)):
            if mine := [q for (_, q), b in zip(kept, best, strict=True) if b[1] == k]:
                centers[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    best, top = assign(), (1 << 63) - 1
    of = [sum(d for d, k in best if k == n) for n in range(len(centers))]
    return sorted(((i, k, min(d, top), min(of[k], top), min(sum(of), top), sha(",".join(map(str, centers[k])))) for (i, _), (d, k) in zip(kept, best, strict=True)), key=str)


def clusters_of(df, **more):
    return sorted((tuple(r) for r in op11_centroids.cluster(df, **more).collect()), key=str)


def test_clusters_on_edge_rows(spark):
    rows = edges()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert clusters_of(df) == plain_clusters(rows)
    assert op11_centroids.cluster(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    nothing = op11_centroids.cluster(df.where("vec_id > 900 and vec_id < 907"))
    assert nothing.count() == 0 and nothing.dtypes == op11_centroids.cluster(df).dtypes


def test_clusters_of_few_and_of_very_large_vectors(spark):
    few = [(i, [float(i)] * 3, "", "", 0) for i in range(5)]
    assert clusters_of(spark.createDataFrame(few, SCHEMA), dims=3) == plain_clusters(few, dims=3)
    large = [(i, [(-1.0) ** i * 1e6 * i, 3e5 + i, 0.5], "", "", 0) for i in range(30)]
    assert clusters_of(spark.createDataFrame(large, SCHEMA), dims=3) == plain_clusters(large, dims=3)
    beyond = [(1, [1e300, 0.0, 0.0], "", "", 0), (2, [-1e300, 0.0, 0.0], "", "", 0), (3, [1.0, 0.0, 0.0], "", "", 0)]
    got = clusters_of(spark.createDataFrame(beyond, SCHEMA), dims=3, clusters=1)
    assert len(got) == 3 and all(r[4] == (1 << 63) - 1 for r in got)


def test_clusters_do_not_hang_on_how_rows_lie(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = [tuple(r) for r in df.collect()]
    want = plain_clusters(rows, rounds=3)
    assert clusters_of(df, rounds=3) == want == clusters_of(df.repartition(7, "vec_id"), rounds=3)


def plain_nearest(rows, every=100, k=10):
    kept = [(i, v) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (q, v) in enumerate(kept):
        if q is not None and q % every == 0:
            near = sorted((math.sqrt(sum((a - b) * (a - b) for a, b in zip(v, w, strict=True))), i is None, i or 0) for m, (i, w) in enumerate(kept) if m != n and len(w) == len(v))
            out += [(q, r + 1, None if none else i, s) for r, (s, none, i) in enumerate(near[:k])]
    return sorted(((*x[:3], round(x[3], 9)) for x in out), key=str)


def nearest_of(df, **more):
    return sorted(((*tuple(r)[:3], round(r.score, 9)) for r in op13_neighbours.nearest(df, **more).collect()), key=str)


def test_nearest_on_edge_rows(spark):
    rows = edges(n=150)
    rows += [(400 + i, [float(i == c) for c in range(64)], "", "", 0) for i in range(64)]  # all at one distance from each other
    rows += [(600, [1.0, 2.0], "", "", 0), (601, [1.0, 2.5], "", "", 0), (700, [5.0], "", "", 0), (800, [1e300] * 64, "", "", 0), (1000, [1e-200] * 64, "", "", 0)]
    rows += [(1200 + i % 3, [0.25] * 64, "", "", 0) for i in range(40)]  # one vector, repeated ids, more copies than are asked for
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = op13_neighbours.nearest(df)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert nearest_of(df) == plain_nearest(rows)
    assert nearest_of(df.where("vec_id between 901 and 906")) == [] == nearest_of(df.where("vec_id = 600"))


def test_nearest_with_cells_and_shards(spark, monkeypatch):
    monkeypatch.setattr(op13_neighbours, "PER_CELL", 200)
    monkeypatch.setattr(op13_neighbours, "SHARD", 64)
    monkeypatch.setattr(op13_neighbours, "SEEDS", 50)
    draw = random.Random(1)
    middle = [[draw.uniform(-1, 1) for _ in range(20)] for _ in range(6)]
    rows = [(i, [c + draw.gauss(0, 0.1) for c in middle[i % 6]], "", "", 0) for i in range(3000)]
    got, want = set(nearest_of(spark.createDataFrame(rows, SCHEMA))), set(plain_nearest(rows))
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)


def test_error_bound_prunes_and_keeps_the_nearest(spark, sf):
    """On vectors without clusters the bound leaves most vectors out, and loses next to nothing."""
    import numpy as np

    x = np.random.default_rng(0).standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist(), "", "", 0) for i, v in enumerate(x)]
    got, want = set(nearest_of(spark.createDataFrame(rows, SCHEMA))), set(plain_nearest(rows))
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)
    given = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert set(nearest_of(given)) == set(plain_nearest([tuple(r) for r in given.select("vec_id", "embedding").collect()]))
