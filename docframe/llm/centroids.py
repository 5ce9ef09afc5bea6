"""Centroid clustering in exact integers, by Hamerly's bounds.

Each vector keeps two numbers from round to round: an upper bound of the distance to its own centroid and a lower bound of
the distance to every other one. Centroids drift between rounds, and the bounds are loosened by that much. Where the bounds
still tell the own centroid apart, nothing is computed; where they don't, the upper one is made exact, and if that is not
enough, the vector is ambiguous and gets a full scan in integers. Bounds are doubles rounded outwards, so they never decide
a tie. Sums follow only the vectors that moved, and only sums by centroid and component reach the driver.

Defined results: vectors that are null, or have another length, null or non-finite components, are left out. Repeated rows
count as often as they stand there. A vector without an id is never a first centroid, as it has no hash; rows of one id have
one hash and go by their components. Fewer vectors than centroids give as many centroids as vectors. Equal centroids are
told apart by their number. No vectors give no rows. Components beyond 2^27 after scaling are an error, as distances would
not fit into a long. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remove_since, small_batches, table, written

#: Rounding of the bounds: far more than what sums and roots of doubles lose.
SLACK = 1e-9
#: Scaled components up to which squared distances of 64 components fit into a long.
MOST = 1 << 27

_STATE = "id long, vector array<int>, before int, cluster int, upper double, lower double"


def integers(rows: DataFrame, key: str, vector: str, length: int, scale: int) -> DataFrame:
    """(id, vector array<int>): floor(scale * x) of each component of the vectors that count."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    fits = F.when(F.forall(x, lambda v: F.abs(v) * F.lit(float(scale)) <= float(MOST)), scaled).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST} / {scale}")).cast("array<bigint>"))
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) == length) & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(key).cast("long").alias("id"), fits.cast("array<int>").alias("vector"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the k smallest hashes of `seed:id`, as rows."""
    ordered = vectors.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "vector")
    return np.array([r["vector"] for r in ordered.orderBy("h", "vector").limit(k).collect()], np.int64)


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1).astype(np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each centroid, exact."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def _up(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + SLACK)


def _down(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 - SLACK)


class Move:
    """What one round has to know: centroids, how far each has drifted at most, and half the way to its nearest neighbour at least."""

    def __init__(self, centroids: np.ndarray, old: np.ndarray) -> None:
        self.centroids, k = centroids, len(centroids)
        diff = centroids - old
        self.drift = _up(np.einsum("ij,ij->i", diff, diff))
        between = squared(centroids, centroids).astype(np.float64)
        np.fill_diagonal(between, np.inf)
        self.half = np.sqrt(between.min(axis=1)) / 2 * (1 - SLACK) if k > 1 else np.full(1, np.inf)
        most = np.argsort(self.drift)[::-1]
        #: For each centroid the largest drift of the others.
        self.others = np.full(k, self.drift[most[0]])
        self.others[most[0]] = self.drift[most[1]] if k > 1 else 0.0

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's nearest centroid, the smaller number of equals, and its bounds."""
        cluster, upper, lower = cluster.copy(), (upper + self.drift[cluster]) * (1 + SLACK), (lower - self.others[cluster]) * (1 - SLACK)
        lower = np.maximum(lower, 0.0)
        sure = lambda at: upper[at] < np.maximum(lower[at], self.half[cluster[at]])
        open_ = np.flatnonzero(~sure(slice(None)))
        if len(open_):
            d = x[open_] - self.centroids[cluster[open_]]
            upper[open_] = _up(np.einsum("ij,ij->i", d, d))
            open_ = open_[~sure(open_)]
        if len(open_):
            all_ = squared(x[open_], self.centroids)
            best = all_.argmin(axis=1)
            own = all_[np.arange(len(best)), best]
            all_[np.arange(len(best)), best] = np.iinfo(np.int64).max
            cluster[open_], upper[open_] = best, _up(own)
            lower[open_] = _down(all_.min(axis=1)) if len(self.centroids) > 1 else np.inf
        return cluster, upper, lower


def _assigned(move: Move, fresh: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, x = b.num_rows, _matrix(b.column(1), b.num_rows)
            if fresh:  # nothing is known yet: bounds that are never sure
                before, cluster, upper, lower = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n)
            else:
                before = cluster = b.column(3).to_numpy()
                upper, lower = b.column(4).to_numpy(), b.column(5).to_numpy()
            now, upper, lower = move.assign(x, cluster, upper, lower)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(before, pa.int32()), pa.array(now, pa.int32()), pa.array(upper), pa.array(lower)], names=["id", "vector", "before", "cluster", "upper", "lower"]
            )

    return run


def _moved(k: int, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task's moved vectors change: for each centroid a row (cluster, sums), the count behind the components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Python integers, as a task's sums may outgrow 64 bits
        sums, n = [[0] * (length + 1) for _ in range(k)], 0
        for b in batches:
            if not b.num_rows:
                continue
            n += b.num_rows
            x = np.column_stack([_matrix(b.column(0), b.num_rows), np.ones(b.num_rows, np.int64)])
            for column, sign in ((b.column(1), -1), (b.column(2), 1)):
                c = column.to_numpy()
                for j in np.unique(c[c >= 0]).tolist():
                    sums[j] = [s + sign * v for s, v in zip(sums[j], x[c == j].sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([[str(v) for v in s] for s in sums], pa.list_(pa.string()))], names=["cluster", "sums"])

    return run


def _changes(state: DataFrame, k: int, length: int) -> dict[tuple[int, int], int]:
    """The change of each (centroid, component), k * (length + 1) numbers at most."""
    moved = state.where("before <> cluster").select("vector", "before", "cluster")
    parts = moved.mapInArrow(_moved(k, length), "cluster int, sums array<string>").select("cluster", F.posexplode("sums").alias("at", "v"))
    return {(r[0], r[1]): int(r[2]) for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect()}


def clustered(vectors: DataFrame, first: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(id, vector, before, cluster, upper, lower) after `rounds` rounds and a last assignment, a written table; and the centroids."""
    spark, (k, length) = vectors.sparkSession, first.shape
    small_batches(spark)
    totals = [[0] * (length + 1) for _ in range(k)]
    centroids, old, state = first, first, vectors
    for turn in range(rounds + 1):
        begun = len(written())
        state = materialize(state.mapInArrow(_assigned(Move(centroids, old), turn == 0), _STATE), f"round{turn}")
        if turn:
            remove_since(spark, begun - 1, keep=1)  # the round before
        if turn == rounds:
            break
        for (c, at), v in _changes(state, k, length).items():
            totals[c][at] += v
        old, centroids = centroids, np.array([[v // t[-1] for v in t[:-1]] if t[-1] else c.tolist() for t, c in zip(totals, centroids, strict=True)], np.int64)
    return state, centroids


def _distance(vector: Column, centroid: Column) -> Column:
    return F.aggregate(F.zip_with(vector, centroid, lambda x, c: (x.cast("long") - c) * (x.cast("long") - c)), F.lit(0).cast("long"), lambda s, d: s + d)


def cluster(rows: DataFrame, key: str, vector: str, k: int = 8, rounds: int = 10, length: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of `length` components."""
    spark, begun = rows.sparkSession, len(written())
    vectors = materialize(integers(rows, key, vector, length, scale), "vectors")
    first = first_centroids(vectors, k, seed)
    if not len(first):
        remove_since(spark, begun)
        return spark.createDataFrame([], f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state, centroids = clustered(vectors, first, rounds)
    ends = [(j, c.tolist(), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    known = F.broadcast(spark.createDataFrame(ends, "cluster int, centroid array<long>, centroid_sha256 string"))  # k rows
    placed = materialize(state.join(known, "cluster").select("id", "cluster", _distance(F.col("vector"), F.col("centroid")).alias("distance"), "centroid_sha256"), "placed")
    sums = {r[0]: int(r[1]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    if math.fsum(sums.values()) >= 2.0**63:
        raise OverflowError("the inertia does not fit into a long")
    own = F.element_at(F.create_map(*[F.lit(v) for c, s in sums.items() for v in (c, s)]), F.col("cluster")).cast("long")
    remove_since(spark, begun, keep=1)
    return placed.select(F.col("id").alias(key), "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
