"""Centroid clustering against all distances in plain Python, and against its SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import drake, queries


def brute(rows, k=40, rounds=5, dims=64, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        held = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), h in zip(kept, held, strict=True) if h == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    part = {n: sum(d for _, d, m in found if m == n) for n in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, part[n], sum(part.values()), names[n]) for i, d, n in found), key=repr)


def got(df, **kw):
    return sorted(map(tuple, drake.cluster(df, **kw).collect()), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label string"


def test_equals_all_distances(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(df.repartition(3)) == brute(rows)


def test_edges(spark):
    rng = np.random.default_rng(5)
    few = [[float(x) / 256 for x in rng.integers(-3, 4, 4)] for _ in range(300)]  # many ties
    rows = [(i % 250, v) for i, v in enumerate(few)] + [(None, few[0]), (None, few[1]), (7, None), (8, []), (9, [1.0, 2.0, 3.0]), (10, [1.0, None, 0.0, 0.0]), (11, [float("nan"), 0.0, 0.0, 0.0]), (12, [float("inf"), 0.0, 0.0, 0.0]), (13, [-0.001, 1000.5, -1000.5, 0.0])]
    rows += [(300 + k, few[5]) for k in range(200)]  # one vector holds a third of the rows
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).withColumns({c: F.lit("x") for c in ("vec", "near", "low", "rest", "used", "cluster", "distance")})
    for k in (1, 2, 7, 40):
        assert got(df.repartition(4), k=k, dims=4) == brute(rows, k=k, dims=4)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(k, [float(k), 1.0]) for k in range(5)]
    assert got(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), dims=2) == brute(rows, dims=2)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    with pytest.raises(Exception, match="fit a long"):
        got(spark.createDataFrame([(1, [1e30, 0.0], "")], SCHEMA), dims=2)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 30), st.integers(1, 9), st.sampled_from([3, 1000, 1 << 26]))
def test_bounds_certify_only_the_nearest(seed, k, b, size):
    """Round after round of small moves: the first is always the nearest, by number among equals."""
    rng = np.random.default_rng(seed)
    x, centroids = rng.integers(-size, size + 1, (50, 3)), rng.integers(-size, size + 1, (k, 3))
    held = drake.Bounds.scanned(x, centroids, min(b, k - 1))
    for _ in range(5):
        after = centroids + rng.integers(-max(size // 20, 1), max(size // 20, 1) + 1, centroids.shape) * (rng.random(k) < 0.5)[:, None]
        held.moved(np.sqrt(((after - centroids) ** 2).sum(1).astype(float)) * (1 + drake.WIDER))
        centroids = after
        held.certify(x, centroids)
        exact = drake.squared(x, centroids)
        assert (held.near[:, 0] == exact.argmin(1)).all()
        root = np.sqrt(exact.astype(float))
        assert (held.low[:, 0] >= np.take_along_axis(root, held.near[:, :1], 1)[:, 0] * (1 - 1e-15)).all()
        assert (held.low[:, 1:] <= np.take_along_axis(root, held.near[:, 1:], 1) * (1 + 1e-15)).all()
        others = np.ones_like(root, bool)
        np.put_along_axis(others, held.near, False, 1)
        assert (held.rest <= np.where(others, root, np.inf).min(1) * (1 + 1e-15)).all()
        held = held.shortened(max(held.near.shape[1] - 2, min(1, k - 1)))


def test_bounds_save_distances(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 1, (12, 8))
    rows = [(k, (centers[k % 12] + rng.normal(0, 0.1, 8)).tolist(), "") for k in range(3000)]
    state, _ = drake.states(spark.createDataFrame(rows, SCHEMA), 12, 5, 8)
    spent = state.agg(F.sum("computed")).first()[0]
    assert spent < 0.5 * 3000 * 12 * 6


def test_matches_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op11_drake_clusters"])
    df = queries.op11_drake_clusters(spark, small)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
