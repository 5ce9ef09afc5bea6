"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target of words. A document's copies are target / source size on average: a whole part that it gets for
certain and a fraction that is rounded so that sums stay. Documents with fractions meet; words move from one to the other,
by chance in either direction so that each keeps its mean, until one fraction is 0 or 1. A larger document meets all smaller
ones of its bucket at once, as long as these can take or give its words: chance rounds it, and its words are spread over
their fractions. The few smallest then meet in pairs. What remains of a bucket is one small document with a fraction; these
meet again in wider buckets, in a tree, until a source has one, which chance decides. A source's words so differ from its
target by less than the size of one of its small documents.

Buckets and chances hang on hashes of doc_id, source and text, not on how Spark deals rows, so reruns agree.

Defined results: null and empty texts have size 0, take no words, and their copies are rounded each by itself (once each in
a source without words); null is a source of its own, after all others; rows of equal doc_id are rows of their own; mix()
does not read extra columns, apply() tells rows apart by them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, materialize, row_hash, small, table

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MOST_COPIES = 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source's bucket, about, and buckets that meet at each level of the tree.
BUCKET_ROWS, FAN = 2000, 64
_COLUMNS = ("doc_id", "row_mark", "source", "size", "source_size", "target", "bucket", "buckets", "chance")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target). sizes has a row (source, source_size) for each source.

    Targets are in proportion to weights up to a level at which some stop at `most` times their size: sorted by the level
    at which they stop, those before the first that does not are full. The windows hold one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    full = F.col("source_size") * F.lit(most)
    w = sizes.withColumn("weight", weight).withColumn("stops", full / F.col("weight"))
    order = Window.orderBy("stops", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    leveled = w.withColumn("level", (total - before) / rest)
    level = F.min(F.when(F.col("stops") > F.col("level"), F.struct("stops", "level"))).over(Window.partitionBy())["level"]
    target = F.least(full, F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"))


def _chances(mark: np.ndarray, level: int) -> np.ndarray:
    """Uniform numbers from row hashes, other ones at each level."""
    x = mark.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def pivot(p: np.ndarray, size: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions p in order; returns them and the place of the one that is left with a fraction, or -1."""
    p = p.tolist()
    held = -1
    for k, (s, u) in enumerate(zip(size.tolist(), chance.tolist())):
        q = p[k]
        if q <= 0.0 or q >= 1.0:
            continue
        if s == 0:
            p[k] = 1.0 if u < q else 0.0
            continue
        if held < 0:
            held = k
            continue
        c, t = p[held], float(size[held])
        gain, loss = min((1 - q) * s, c * t), min(q * s, (1 - c) * t)  # words that k can take, and give
        if u * (gain + loss) < loss:
            if (1 - q) * s <= c * t:
                p[k], p[held] = 1.0, max(0.0, c - gain / t)
            else:
                p[k], p[held] = q + gain / s, 0.0
        elif q * s <= (1 - c) * t:
            p[k], p[held] = 0.0, min(1.0, c + loss / t)
        else:
            p[k], p[held] = q - loss / s, 1.0
        # what is integral is done; a fraction within 1e-12 of one counts as that
        for j in (held, k):
            if p[j] < 1e-12 or p[j] > 1 - 1e-12:
                p[j] = float(round(p[j]))
        held = k if 0.0 < p[k] < 1.0 else held if 0.0 < p[held] < 1.0 else -1
    return np.array(p), held


def spread(p: np.ndarray, size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Rounds the larger of fractions p, sizes in descending order, and spreads the words that each gains or loses over the smaller ones.

    A smaller one takes part by how far it may move either way, so that both ways keep its mean. A document with more words
    than the smaller ones have room for is left.
    """
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1) & (size > 0))
    q, s, u = p[open_], size[open_].astype(np.float64), chance[open_]
    for k in range(len(open_) - 1):
        c, t = q[k], s[k]
        if not 0.0 < c < 1.0:
            continue
        rest = q[k + 1 :]
        room = np.minimum(rest, (1 - rest) * (1 - c) / c)  # what each can give if this one is taken, so that it can take as much for its mean if not
        words = float(room @ s[k + 1 :])
        if words < (1 - c) * t:
            continue
        up = u[k] < c
        rest -= (1 if up else -c / (1 - c)) * (1 - c) * t / words * room
        q[k] = 1.0 if up else 0.0
        rest[rest < 1e-12], rest[rest > 1 - 1e-12] = 0.0, 1.0
    p[open_] = q
    return p


def _round(level: int):
    """Rounds each (source, bucket) of a partition, whose rows are adjacent and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            n = t.num_rows
            source = t.column("source").combine_chunks().dictionary_encode()
            source = (source.chunk(0) if isinstance(source, pa.ChunkedArray) else source).indices.fill_null(-1).to_numpy(zero_copy_only=False)
            bucket, size = t.column("bucket").to_numpy(), t.column("size").to_numpy()
            p, chance = t.column("p").to_numpy().copy(), _chances(t.column("chance").to_numpy(), level)
            cut = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (source[1:] != source[:-1])])
            buckets = t.column("buckets").to_numpy()
            for a, b in zip(cut, np.r_[cut[1:], n]):
                p[a:b], held = pivot(spread(p[a:b], size[a:b], chance[a:b]), size[a:b], _chances(t.column("chance").to_numpy()[a:b], level + 200))
                if buckets[a] == 1 and held >= 0:
                    p[a + held] = float(_chances(t.column("chance").to_numpy()[a + held : a + held + 1], level + 100)[0] < p[a + held])
            yield from t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            if rest.num_rows >= 50_000:
                same = (rest.column("bucket").to_numpy() == rest.column("bucket")[-1].as_py()) & np.array([x == rest.column("source")[-1].as_py() for x in rest.column("source").to_pylist()])
                other = np.flatnonzero(~same)
                if len(other):
                    yield from done(rest.slice(0, other[-1] + 1))
                    rest = rest.slice(other[-1] + 1)
        if rest is not None and rest.num_rows:
            yield from done(rest)

    return run


def mix(docs: DataFrame, mark: Column | None = None) -> DataFrame:
    """(doc_id, row_mark, source, size, source_size, target, copies) for each row of docs.

    mark: tells rows of equal doc_id, source and text apart, where that matters.
    """
    spark = docs.sparkSession
    own = F.xxhash64("doc_id", "source", "text")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", (own if mark is None else mark).alias("row_mark"), own.alias("own"), "source", size.alias("size"))
    rows = materialize(sized, "sized")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    wanted = targets(sources).withColumnRenamed("source", "name")
    own_buckets = sources.select(F.col("source").alias("of"), F.ceil(F.col("n") / BUCKET_ROWS).cast("long").alias("buckets"))
    wanted = wanted.join(own_buckets, F.col("name").eqNullSafe(F.col("of"))).drop("of")
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    known = rows.join(wanted, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "own"), F.col("buckets")))
    known = known.withColumn("chance", F.xxhash64(F.lit("chance"), "own")).withColumn("mean", mean)
    now = known.select(*_COLUMNS, F.floor("mean").cast("long").alias("base"), (F.col("mean") - F.floor("mean")).alias("p"))
    n, level, finished = int(spark.conf.get("spark.sql.shuffle.partitions")), 0, []
    while True:
        dealt = now.repartition(n, "source", "bucket").sortWithinPartitions("source", "bucket", F.col("size").desc(), "chance", "doc_id", "row_mark")
        out = materialize(dealt.mapInArrow(_round(level), dealt.schema), f"level{level}")
        whole = (F.col("p") == 0) | (F.col("p") == 1)
        finished.append(out.where(whole))
        if out.where(~whole).isEmpty():
            break
        level += 1
        now = out.where(~whole).withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long")).withColumn("buckets", F.ceil(F.col("buckets") / FAN).cast("long"))
    result = finished[0]
    for part in finished[1:]:
        result = result.union(part)
    return result.select("doc_id", "row_mark", "source", "size", "source_size", "target", (F.col("base") + F.col("p").cast("long")).alias("copies"))


def apply(docs: DataFrame) -> DataFrame:
    """Rows of docs, each as often as the mix has it. Rows that are equal in every column share their copies.

    Texts stay where they are as long as the copies' numbers can be broadcast, and are shuffled once beyond that.
    """
    mark, number, n, mixed_id, mixed_mark = (free_name(docs, x) for x in ("row_mark", "copy_number", "copies", "mixed_id", "mixed_mark"))
    mixed = mix(docs, row_hash(docs)).groupBy(F.col("doc_id").alias(mixed_id), F.col("row_mark").alias(mixed_mark))
    copies = materialize(mixed.agg(F.sum("copies").cast("int").alias(n), F.count("*").alias("times")).where(F.col(n) > 0), "copies")
    marked = docs.select("*", row_hash(docs).alias(mark))
    same = F.col("doc_id").eqNullSafe(F.col(mixed_id)) & (F.col(mark) == F.col(mixed_mark))
    unit = marked.join(small(copies.where("times = 1").drop("times")), same)
    if not copies.where("times > 1").isEmpty():
        unit = unit.union(marked.join(small(copies.where("times > 1").drop("times")), same).dropDuplicates(["doc_id", mark]))
    return unit.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
