"""Centroid clustering against full scans in Python's integers."""

import hashlib
import math
import random

import pytest

from docframe.llm import centroids


def brute(rows, k=8, rounds=10, length=64, scale=1024):
    kept = [(v, [math.floor(scale * x) for x in e]) for v, e in rows if e is not None and len(e) == length and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted((hashlib.sha256(f"3:{v}".encode()).hexdigest(), e) for v, e in kept if v is not None)
    c = [e for _, e in order[:k]]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    for turn in range(rounds + 1):
        to = [min(range(len(c)), key=lambda j: (dist(e, c[j]), j)) for _, e in kept]
        if turn < rounds:
            for j in range(len(c)):
                own = [e for (_, e), t in zip(kept, to) if t == j]
                if own:
                    c[j] = [sum(x) // len(own) for x in zip(*own)]
    d = [dist(e, c[t]) for (_, e), t in zip(kept, to)]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((v, t, x, sum(y for y, s in zip(d, to) if s == t), sum(d), sha[t]) for (v, _), t, x in zip(kept, to, d)), key=str)


def found(df, **more):
    return sorted((tuple(r) for r in centroids.cluster(df, "vec_id", "embedding", **more).collect()), key=str)


def test_given(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = centroids.query(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_ties_repeats_and_few_values(spark, seed):
    rng = random.Random(seed)
    rows = [(v, [rng.choice([0.0, 0.25, -0.25, 1.0]) for _ in range(4)]) for v in range(60)]
    rows += rows[:5] + [(None, rows[0][1])] + [(1, [0.5, 0.5, -0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, length=4) == brute(rows, length=4)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [0.1 * k, -0.3]) for k in range(4)]
    rows = [*good, (10, None), (11, []), (12, [1.0]), (13, [1.0, None]), (14, [nan, 1.0]), (15, [inf, 1.0]), (16, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, id string")
    got = found(df, length=2)
    assert [r[0] for r in got] == [0, 1, 2, 3] and len({r[1] for r in got}) == 4 and all(r[2] == 0 for r in got)
    assert found(df.where("vec_id > 9"), length=2) == []
    assert found(df.where("vec_id = 2"), length=2)[0][1:5] == (0, 0, 0, 0)
    with pytest.raises(Exception, match="beyond"):
        found(spark.createDataFrame([(1, [1e30, 0.0])], df.select("vec_id", "embedding").schema), length=2)


def test_bounds_skip_most_scans(spark, monkeypatch):
    """Far clusters: after the first rounds no vector is ambiguous."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = (rng.integers(0, 4, (400, 1)) * 1000 + rng.integers(-20, 20, (400, 8))).astype(np.int64)
    c = np.array([np.full(8, k * 1000) for k in range(4)])
    move = centroids.Move(c, c)
    cluster, upper, lower = move.assign(x, np.zeros(400, np.int32), np.full(400, np.inf), np.zeros(400))
    scans = []
    monkeypatch.setattr(centroids, "squared", lambda a, b, f=centroids.squared: scans.append(len(a)) or f(a, b))
    again = centroids.Move(c + 1, c)
    scans.clear()
    now, upper, lower = again.assign(x, cluster, upper, lower)
    assert not sum(scans) and (now == cluster).all()
