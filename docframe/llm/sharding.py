"""Sharding by balanced label propagation, under the law of near equal bytes.

Documents of equal text are linked. All start in a shard by hash; then, in rounds, each linked document wants the shard
that most of its group is in, and moves there under quotas: linked documents alone may fill a shard up to its capacity,
and the share of those that may go from one shard to another is set so that no shard goes beyond it. What hangs on nothing
then evens the sizes: shards over the mean give documents, those without links first and small ones before large ones, to
shards under it, at exact running sums, so a shard ends within about the size of one small document of the mean. A document larger than the mean has a shard
nearly to itself, and the others share the rest evenly.

A group of any size is met as sums by shard only. Running sums and slots come from range partitions: a running sum in
each, and the sums of all partitions before it.

Defined results: a null text has size 1 and the checksum of no bytes, and null texts are a group; rows of equal doc_id are
rows of their own, and take slots in the order of doc_id, null first, then of text; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fraction, materialize, table

SHARDS = 8
ROUNDS = 3
#: A shard's capacity over the mean, for linked documents.
SLACK = 1.0


def _running(shard: int, weight: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), {}
        for batch in batches:
            s, w = batch.column(shard).to_numpy(), batch.column(weight).to_numpy()
            before = np.zeros(len(s), dtype=np.int64)
            for k in np.unique(s):
                own = s == k
                end = np.cumsum(w[own]) + total.get(int(k), 0)
                before[own] = end - w[own]
                total[int(k)] = int(end[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(s), part, dtype=np.int32)), pa.array(before)], names=[*batch.schema.names, "part", "before"])

    return run


def running_sum(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """df with a column `before`: the sum of weight over the rows of its shard that order puts before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, "shard", *order).sortWithinPartitions("shard", *order)
    schema = T.StructType([*df.schema, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])
    local = materialize(dealt.mapInArrow(_running(df.columns.index("shard"), df.columns.index(weight)), schema), name)
    sums = local.groupBy("shard", "part").agg(F.max(F.col("before") + F.col(weight)).alias("n")).collect()  # a row for each partition, and for each shard's end
    offsets, total = [], {}
    for s, p, x in sorted(map(tuple, sums)):
        offsets.append((s, p, total.get(s, 0)))
        total[s] = total.get(s, 0) + x
    known = df.sparkSession.createDataFrame(offsets, "shard int, part int, base long")
    return local.join(F.broadcast(known), ["shard", "part"]).withColumn("before", F.col("before") + F.col("base")).drop("part", "base")


def quotas(demand: np.ndarray, linked: np.ndarray, capacity: float) -> np.ndarray:
    """Shares of the demand from shard to shard that keep the linked bytes of every shard within capacity."""
    share = np.where(demand > 0, 1.0, 0.0)
    np.fill_diagonal(share, 0.0)
    for _ in range(60):
        out, into = (demand * share).sum(axis=1), (demand * share).sum(axis=0)
        room = np.maximum(capacity - (linked - out), 0.0)
        scale = np.where(into > room, room / np.maximum(into, 1e-9), 1.0)
        if (scale > 1 - 1e-6).all():
            break
        share *= scale
    return share


def goals(total: int, largest: np.ndarray) -> np.ndarray:
    """Sizes that shards should end with: all alike, but for a document larger than that, which fills a shard by itself."""
    level, alone = total / len(largest), np.zeros(len(largest), dtype=bool)
    while (new := ~alone & (largest > level)).any() and not (alone | new).all():
        alone |= new
        level = (total - largest[alone].sum()) / (~alone).sum()
    return np.where(alone, largest, level)


def _lookup(values: np.ndarray, *keys: Column) -> Column:
    """An entry of a small matrix by column values."""
    if not keys:
        return F.lit(float(values))
    return F.element_at(F.array(*[_lookup(v, *keys[1:]) for v in values]), keys[0] + 1)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    first = docs.select("doc_id", (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(F.col("text").isNull(), "text").alias("h"))
    rows = materialize(first.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "h"), F.lit(shards)).cast("int")), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    mean = total / shards
    for turn in range(ROUNDS):
        here = [F.sum((F.col("shard") == k).cast("long")) for k in range(shards)]
        groups = rows.groupBy(F.col("h").alias("group_h")).agg(F.count("*").alias("copies"), F.array(*here).alias("here"), F.max("size").alias("each")).where("copies > 1")
        found = groups.select("group_h", (F.array_position("here", F.array_max("here")) - 1).cast("int").alias("wanted"), (F.col("copies") * F.col("each")).alias("group_bytes"))
        wanted = materialize(found, f"groups{turn}")  # as a table it leaves a hot group's rows free to be split in the join
        base = rows.select("doc_id", "size", "text_crc32", "h", "shard")
        linked = materialize(base.join(wanted, F.col("h") == F.col("group_h"), "left").drop("group_h"), f"linked{turn}")
        demand, load = np.zeros((shards, shards)), np.zeros(shards)
        for s, w, b in linked.where("wanted is not null").groupBy("shard", "wanted").agg(F.sum("size")).collect():  # shards squared
            load[s] += b
            demand[s, w] += b * (s != w)
        share = quotas(demand, load, SLACK * mean)
        go = F.col("wanted").isNotNull() & (fraction(F.lit(turn), "doc_id", "h") < _lookup(share, F.col("shard"), F.coalesce("wanted", F.lit(0))))
        rows = linked.withColumn("shard", F.when(go, F.col("wanted")).otherwise(F.col("shard")))
    rows = materialize(rows, "propagated")
    load, largest = np.zeros(shards), np.zeros(shards)
    for s, b, n in rows.groupBy("shard").agg(F.sum("size"), F.max("size")).collect():
        load[s], largest[s] = b, n
    goal = goals(total, largest)
    over, under = np.maximum(load - goal, 0.0), np.maximum(goal - load, 0.0)
    start, room = np.cumsum(over) - over, np.r_[0.0, np.cumsum(under)]
    # documents without links first, then those of the largest groups, which are in many shards anyway
    rank = F.when(F.col("wanted").isNull(), F.lit(0)).when(F.col("group_bytes") > mean / 2, F.lit(1)).otherwise(F.lit(2))
    giving = F.array_contains(F.array(*[F.lit(int(k)) for k in np.flatnonzero(over)]), F.col("shard")) if over.any() else F.lit(False)
    marked = rows.select("doc_id", "size", "text_crc32", "h", "shard", rank.alias("rank"))
    ordered = running_sum(marked.where(giving), ["rank", "size", "h", "doc_id"], "size", "giving")
    middle = F.col("before") + F.col("size") / 2  # a document goes where its middle lies
    place = _lookup(start, F.col("shard")) + middle
    target = F.lit(shards - 1)
    for k in reversed(range(shards)):
        target = F.when(place < F.lit(float(room[k + 1])), F.lit(k)).otherwise(target)
    moved = ordered.withColumn("shard", F.when(middle < _lookup(over, F.col("shard")), target).otherwise(F.col("shard")).cast("int"))
    columns = ["doc_id", "size", "text_crc32", "h", "shard"]
    placed = materialize(marked.where(~giving).select(*columns).union(moved.select(*columns)), "placed")
    counted = running_sum(placed.withColumn("one", F.lit(1).cast("long")), ["doc_id", "h"], "one", "slots")
    return counted.select("doc_id", "size", "text_crc32", "shard", F.col("before").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
