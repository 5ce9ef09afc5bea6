"""Embedding near-duplicates by lattice hashing.

Each table projects vectors at random to one or more blocks of eight dimensions, scales them and takes the nearest point of
the lattice E8 in each block; the points together are the vector's own cell. A vector also visits cells that are one lattice
step away in one block, nearest first (probes). Two vectors meet in a cell that is the own cell of one of them at least, and
are compared by cosine in double precision. A pair that meets in several cells counts in the one of the smallest key.

PLANS fix blocks, scale, probes and tables by the size of the largest label, so that a vector meets 100 others by chance at
most, however many there are; tables are as many as find 97 % of pairs that are just at COSINE, and more of closer ones.

Equal vectors are one class from the start; classes, not rows, are hashed and compared. A cell with very many classes is
cut into chunks, and pairs of chunks meet in cells of their own. A cell gives sums of links and a spanning forest, never
its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers, and those without a label, have no
links and are components by themselves; vectors of different length do not link; labels are compared as they are, whatever
their type; rows of equal vec_id count as rows; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, materialize, small_batches, table, unite

COSINE = 0.93
CELL_ROWS = 4096
#: Groups up to this size are compared by shifts over many groups at once.
SMALL_GROUP = 48
#: Numbers of vectors that a task holds at once, about.
HELD = 1 << 21
_SEED = 20240229


@dataclass(frozen=True)
class Plan:
    """blocks of eight dimensions; steps: lattice steps that vectors at COSINE are apart in a block, about; probes; tables."""

    blocks: int
    steps: float
    probes: int
    tables: int


#: Vectors of the largest label, at most, and the plan. Of random vectors, a plan's share of all pairs meets: 0.7 %, 0.1 %,
#: 0.005 %, 0.001 % and 0.0002 % as simulated.
PLANS = (
    (10_000, Plan(1, 0.8, 4, 4)),
    (100_000, Plan(2, 0.5, 8, 5)),
    (2_000_000, Plan(3, 0.45, 10, 8)),
    (10_000_000, Plan(4, 0.4, 16, 12)),
    (1 << 62, Plan(5, 0.4, 20, 22)),
)


def plan_for(n: int) -> Plan:
    return next(plan for most, plan in PLANS if n <= most)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum."""
    r = np.rint(x)
    odd = (r.sum(axis=1) % 2) != 0
    gap = x - r
    worst = np.abs(gap).argmax(axis=1)
    rows = np.flatnonzero(odd)
    r[rows, worst[rows]] += np.where(gap[rows, worst[rows]] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, doubled so that they are integers: D8 or D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return (np.where(closer[:, None], b, a) * 2).astype(np.int64)


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: steps to neighbouring points."""
    whole = [[2 * s * (k == i) + 2 * t * (k == j) for k in range(8)] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    half = [[1 if bits >> k & 1 else -1 for k in range(8)] for bits in range(256) if bin(bits).count("1") % 2 == 0]
    return np.array(whole + half, dtype=np.int64)


@lru_cache(maxsize=8)
def _table(dim: int, blocks: int, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(projection, shift, multipliers of the key) of a table."""
    rng = np.random.default_rng([_SEED, dim, blocks, table])
    side, _ = np.linalg.qr(rng.standard_normal((max(dim, 8 * blocks), 8 * blocks)))
    return side[:dim], rng.random(8 * blocks), rng.integers(1, 1 << 62, size=8 * blocks + 3, dtype=np.int64) | 1


def cell_keys(unit: np.ndarray, label: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(keys, own) of unit vectors: sorted keys of all cells that each visits, and which are own ones. label: two numbers."""
    n, dim = unit.shape
    blocks = max(1, min(plan.blocks, dim // 8))
    step = roots()
    scale = plan.steps / np.sqrt((2 - 2 * COSINE) * min(8, dim) / dim)
    keys = np.empty((n, plan.tables, 1 + plan.probes), dtype=np.int64)
    for t in range(plan.tables):
        side, shift, mix = _table(dim, blocks, t)
        x = (unit @ side * scale + shift).reshape(n, blocks, 8)
        own = nearest_e8(x.reshape(-1, 8)).reshape(n, blocks, 8)
        reach = ((x - own / 2) @ step.T.astype(np.float64)).reshape(n, -1)  # the larger, the nearer: all steps have one length
        near = np.argpartition(-reach, plan.probes, axis=1)[:, : plan.probes]
        weight = mix[: 8 * blocks].reshape(blocks, 8)
        with np.errstate(over="ignore"):
            h = (own * weight).sum(axis=(1, 2)) + label[:, 0] * mix[-3] + label[:, 1] * mix[-2] + mix[-1]
            moves = (weight @ step.T).ravel()  # what each step adds to the sum
            h = np.concatenate([h[:, None], h[:, None] + moves[near]], axis=1)
            h = (h ^ (h >> 29)) * np.int64(0x2545F4914F6CDD1D)
        keys[:, t] = h ^ (h >> 32)
    own = np.zeros(keys.shape, dtype=bool)
    own[:, :, 0] = True
    keys, own = keys.reshape(n, -1), own.reshape(n, -1)
    order = np.lexsort((~own, keys), axis=1) if n else np.zeros(keys.shape, dtype=np.int64)
    return np.take_along_axis(keys, order, axis=1), np.take_along_axis(own, order, axis=1)


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of unit length; all rows have as many numbers. The largest number is taken out first, so that none overflows."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _labels(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([rows.column("l1").to_numpy(), rows.column("l2").to_numpy()], axis=1)


def _hash(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("dim").to_numpy())
            for dim in np.unique(size):
                part = batch.filter(pa.array(size == dim))
                for at in range(0, part.num_rows, 1024):
                    rows = part.slice(at, 1024)
                    keys, own = cell_keys(_vectors(rows.column("vector")), _labels(rows), plan)
                    row, col = np.nonzero(np.c_[np.ones(len(keys), bool), keys[:, 1:] != keys[:, :-1]])  # a key that comes twice counts once
                    yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(row)), pa.array(keys[row, col]), pa.array(own[row, col])], names=["id", "key", "own"])

    return run


def _close(x: np.ndarray, group: np.ndarray, may: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group, which are adjacent, that may meet and have a cosine of COSINE or more."""
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[cut, len(group)])
    few = np.flatnonzero(np.repeat(size <= SMALL_GROUP, size))
    for d in range(1, int(size[size <= SMALL_GROUP].max(initial=0))):
        q = few[few + d < len(group)]
        q = q[group[q] == group[q + d]]
        q = q[may(q, q + d)]
        for at in range(0, len(q), 1 << 14):
            a = q[at : at + (1 << 14)]
            a = a[np.einsum("ij,ij->i", x[a], x[a + d]) >= COSINE]
            if len(a):
                yield a, a + d
    for begin, n in zip(cut[size > SMALL_GROUP], size[size > SMALL_GROUP]):
        for at in range(begin, begin + n, 512):
            q, k = np.nonzero(x[at : min(at + 512, begin + n)] @ x[begin : begin + n].T >= COSINE)
            q, k = q + at, k + begin
            ok = q < k
            q, k = q[ok], k[ok]
            ok = may(q, k)
            q, k = q[ok], k[ok]
            for s in range(0, len(q), 1 << 14):
                yield q[s : s + (1 << 14)], k[s : s + (1 << 14)]


def _links(plan: Plan):
    """Sums of links (a, a, n) and spanning links (a, b, 0) of cells, whose rows are adjacent."""

    def links_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        size = t.column("dim").to_numpy()
        for dim in np.unique(size):
            own = t.filter(pa.array(size == dim)).combine_chunks()
            yield from of_one_length(own)

    def of_one_length(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, cell, label = t.column("key").to_numpy(), t.column("cell").to_numpy(), _labels(t)
        other = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]) | (label[1:] != label[:-1]).any(axis=1)
        group = np.cumsum(np.r_[True, other])
        ids, copies, side, at_home = (t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "copies", "side", "own"))
        x = _vectors(t.column("vector").combine_chunks())
        whole = (cell < 0) | (cell // (1 << 20) == cell % (1 << 20))

        def may(q: np.ndarray, k: np.ndarray) -> np.ndarray:
            return (at_home[q] | at_home[k]) & (whole[q] | (side[q] != side[k]))

        n, a, b = np.zeros(len(ids), dtype=np.int64), [], []
        for q, k in _close(x, group, may):
            rows, back = np.unique(np.r_[q, k], return_inverse=True)
            keys, home = cell_keys(x[rows], label[rows], plan)
            once = smallest_common(keys, home, back[: len(q)], back[len(q) :]) == key[q]
            q, k = q[once], k[once]
            np.add.at(n, q, copies[k])
            np.add.at(n, k, copies[q])
            a.append(q)
            b.append(k)
        if a:
            lab = unite(np.arange(len(ids)), np.concatenate(a), np.concatenate(b))
            child, some = np.flatnonzero(lab != np.arange(len(ids))), np.flatnonzero(n)
            out = [np.r_[ids[child], ids[some]], np.r_[ids[lab[child]], ids[some]], np.r_[np.zeros(len(child), np.int64), n[some]]]
            yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        numbers = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            numbers += len(batch.column("vector").flatten())
            if numbers < HELD:
                continue
            rest = pa.Table.from_batches(held)
            key, cell = rest.column("key").to_numpy(), rest.column("cell").to_numpy()
            other = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from links_of(rest.slice(0, cut))
            held = rest.slice(cut).combine_chunks().to_batches()
            numbers = sum(len(h.column("vector").flatten()) for h in held) if cut else 0
        if held:
            yield from links_of(pa.Table.from_batches(held))

    return run


def smallest_common(keys: np.ndarray, own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows a[k] and b[k] of sorted keys the smallest common key that is an own one of a row; the largest int64 if none is."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    left, right, own_left, own_right = keys[a], keys[b], own[a], own[b]
    for j in range(keys.shape[1] - 1, -1, -1):
        same = right == left[:, j : j + 1]
        meet = (same & (own_right | own_left[:, j : j + 1])).any(axis=1)
        out[meet] = left[meet, j]
    return out


def near_duplicates(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows (vec_id, embedding, label)."""
    spark = rows.sparkSession
    number = rows.schema["embedding"].dataType.elementType
    vector = F.col("embedding") if isinstance(number, (T.FloatType, T.DoubleType)) else F.col("embedding").cast("array<double>")
    finite = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vector, lambda v: v != 0)
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite
    label = F.col("label") + F.lit(0.0) if isinstance(rows.schema["label"].dataType, (T.FloatType, T.DoubleType)) else F.col("label")  # -0.0 is 0.0
    known = rows.select("vec_id", vector.alias("vector"), F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64(label).alias("l1"), F.xxhash64(F.lit("label"), label).alias("l2"))
    # rows that link with nothing are classes by themselves
    known = known.withColumn("h", F.when(F.col("sound"), F.xxhash64("l1", "vector")).otherwise(F.xxhash64("vec_id"))).withColumn("g", F.when(F.col("sound"), F.xxhash64("vector", "l2")).otherwise(F.lit(0)))
    grouped = known.where("sound").groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("l1").alias("l1"), F.first("l2").alias("l2"))
    classes = materialize(grouped.withColumn("dim", F.size("vector")), "classes")
    largest = classes.groupBy("dim", "l1", "l2").count().agg(F.max("count")).first()[0] or 0
    plan = plan_for(largest)
    small_batches(spark)
    keyed = materialize(classes.select("id", "dim", "l1", "l2", "vector").mapInArrow(_hash(plan), "id long, key long, own boolean"), "cells")
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("count"), F.max("own").alias("home")).where("count > 1 and home").select("key", "count"), "shared")
    parts = F.when(F.col("count") > CELL_ROWS, F.ceil(F.col("count") / (CELL_ROWS // 2)).cast("long")).otherwise(F.lit(1).cast("long"))
    met = keyed.join(shared, "key").withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64("id", "key"), F.col("parts")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.least(j, F.col("side")) * F.lit(1 << 20) + F.greatest(j, F.col("side")))
    dealt = met.select("id", "key", "own", "side", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(-1).cast("long"))).otherwise(pairs)).alias("cell"))
    full = dealt.join(classes.select("id", "copies", "dim", "l1", "l2", "vector"), "id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = full.repartition(n, "key", "cell").sortWithinPartitions("key", "cell", "l1", "l2", "dim", "id")
    found = materialize(met.mapInArrow(_links(plan), "a long, b long, n long"), "links")
    sums = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    rooted = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "id")
    by_class = classes.select("h", "g", "id", "copies").join(sums, "id", "left").join(rooted, "id", "left")
    result = materialize(by_class.select("h", "g", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")), "by_class")
    linked = known.where("sound").select("vec_id", "h", "g").join(result, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = known.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
