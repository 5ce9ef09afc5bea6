"""Values that styles take from their ancestors: chains are contracted to ever fewer styles, and these then answer the rest.

Each table of styles that is left is smaller by a part than the one before, so all tables together grow with the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import stores

#: Styles whose chains are walked at once, in one task's memory.
CHUNK_ROWS = 1 << 17


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: it cuts the lineage, and lost executors cost no earlier round."""
    folder = stores.scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _doubled(rows: DataFrame, columns: list[str], rounds: int) -> DataFrame:
    """rows (style, jump, depth, least, columns): each takes over what the row at its jump knows, and jumps as far again.

    Ends when nothing jumps any more, or after `rounds`.
    """
    rows = written(rows)
    for _ in range(rounds):
        if rows.where("jump is not null").isEmpty():
            break
        far = rows.select(F.col("style").alias("__style"), F.col("jump").alias("__jump"), F.col("depth").alias("__depth"), F.col("least").alias("__least"), *[F.col(c).alias(f"__{c}") for c in columns])
        met = rows.join(far, F.col("jump") == F.col("__style"), "left")
        own = [F.coalesce(c, f"__{c}").alias(c) for c in columns]
        rows = written(met.select("style", F.col("__jump").alias("jump"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"), F.least("least", "__least").alias("least"), *own))
    return rows


def _walked(rows: pa.Table, columns: list[str]) -> pa.Table:
    """Each style's chain as far as it stays among the rows: it jumps from the last of these, and `ring` says that there is none."""
    up = pc.index_in(rows["jump"].combine_chunks(), value_set=rows["style"].combine_chunks(), skip_nulls=True)
    ahead = pc.fill_null(up, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(ahead)
    last, depth = np.arange(n), rows["depth"].to_numpy().copy()
    known = [np.where(rows[c].is_valid().to_numpy(), np.arange(n), -1) for c in columns]
    for _ in range(n.bit_length() + 1):
        on = np.flatnonzero(ahead >= 0)
        if not len(on):
            break
        far = ahead[on]
        depth[on] += depth[far]
        for k in known:
            k[on] = np.where(k[on] < 0, k[far], k[on])
        last[on], ahead[on] = last[far], ahead[far]
    ring = (ahead >= 0) | rows["ring"].to_numpy()[last]
    depth[ring] = 0
    jump = rows["jump"].take(pa.array(last, mask=ahead >= 0))
    values = [rows[c].take(pa.array(k, mask=k < 0)) for c, k in zip(columns, known, strict=True)]
    return pa.table([rows["style"], jump, pa.array(depth), pa.array(ring), *values], names=["style", "jump", "depth", "ring", *columns])


def _chunks_walked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """_walked() in chunks of rows as they come."""

    most = CHUNK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while (room := most - sum(b.num_rows for b in held)) <= batch.num_rows:
                yield from _walked(pa.Table.from_batches([*held, batch.slice(0, room)]), columns).to_batches()
                batch, held = batch.slice(room), []
            if batch.num_rows:
                held.append(batch)
        if held:
            yield from _walked(pa.Table.from_batches(held), columns).to_batches()

    return rows.mapInArrow(run, rows.schema)


def _met(rows: DataFrame, known: DataFrame, columns: list[str], jump: Column) -> DataFrame:
    """rows that take over what is known of the style at their jump; jump: where they then jump."""
    far = known.select(F.col("style").alias("__style"), F.lit(True).alias("__there"), *[F.col(c).alias(f"__{c}") for c in ("jump", "depth", "ring", *columns)])
    own = [F.coalesce(c, f"__{c}").alias(c) for c in columns]
    deeper = F.col("depth") + F.coalesce("__depth", F.lit(0))
    met = rows.join(far, F.col("jump") == F.col("__style"), "left").withColumn("__to", jump)
    lost = (F.col("jump").isNotNull() & F.col("__there").isNull() & F.col("__to").isNull()).cast("long")  # a parent that is not there is no ancestor
    return met.select("style", F.col("__to").alias("jump"), (deeper - lost).alias("depth"), (F.col("ring") | F.coalesce("__ring", F.lit(False))).alias("ring"), *own)


def _resolved(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (style, jump, depth, ring, columns) without jumps: values and depths of whole chains; `ring` where one ends on a ring.

    Chains are walked inside chunks of neighbours. Only styles that others jump to go on. Where neighbours are seldom
    related, a quarter of the styles, drawn by hash so that none of them jumps to another, is passed over instead.
    """
    passed: list[tuple[DataFrame | None, DataFrame]] = []
    rows, n, near = written(rows), None, True
    while n is None or n > CHUNK_ROWS:
        if near:
            rows = written(_chunks_walked(rows.repartitionByRange("style").sortWithinPartitions("style"), columns))
            before = rows.count() if n is None else n
            passed.append((None, rows))
            aims = written(rows.where("jump is not null").select(F.col("jump").alias("__aim")).distinct())
            rows = written(rows.join(aims, F.col("style") == F.col("__aim"), "left_semi"))
        else:
            bit = lambda c: F.xxhash64(c, F.lit(len(passed))).bitwiseAND(1) == 1
            leaves = F.col("jump").isNull() | bit(F.col("style")) & ~bit(F.col("jump"))
            out, stay = rows.where(leaves), rows.where(~leaves)
            passed.append((rows.where("jump is null"), out.where("jump is not null")))
            met = _met(stay, out, columns, F.when(F.col("__there"), F.col("__jump")).otherwise(F.col("jump")))
            alone = F.coalesce(F.col("jump") == F.col("style"), F.lit(False))
            rows = written(met.withColumns({"ring": F.col("ring") | alone, "jump": F.when(~alone, F.col("jump"))}))
            before = n
        n = rows.count()
        near = near and n < 0.75 * before
    end = F.lit(None).cast(rows.schema["jump"].dataType)
    lost = F.col("jump").isNotNull().cast("long")
    known = written(_chunks_walked(rows.coalesce(1), columns).withColumns({"depth": F.col("depth") - lost, "jump": end}))
    for done, open_ in reversed(passed):
        found = known if done is None else known.unionByName(done)
        answered = _met(open_, found, columns, end)
        known = written(answered if done is None else found.unionByName(answered))
    return known


def _on_rings(start: DataFrame, columns: list[str], rounds: int) -> DataFrame:
    """(style, columns, depth) of styles whose chains end on a ring, by pointer doubling."""
    full = _doubled(start, columns, rounds)
    # after as many steps as there are styles, what still jumps stands on a ring, and all jumps together are the rings
    ring = full.where("jump is not null").select(F.col("jump").alias("on")).distinct()
    ring = written(ring.join(full, F.col("on") == F.col("style")).select("on", F.col("least").alias("ring")))
    sizes = ring.groupBy("ring").agg(F.count("*").alias("size"))
    member = ring.join(sizes, "ring").select("on", F.col("size"))
    cut = start.select("style", "jump", "depth", "least").join(member, F.col("style") == F.col("on"), "left")
    tails = cut.select("style", F.when(F.col("on").isNull(), F.col("jump")).alias("jump"), F.when(F.col("on").isNull(), F.col("depth")).otherwise(F.lit(0)).alias("depth"), "least", F.col("size").alias("__size"))
    walked = _doubled(tails, ["__size"], rounds)
    steps = walked.select(F.col("style").alias("__style"), (F.col("depth") + F.coalesce(F.col("__size") - 1, F.lit(0))).alias("__depth"))
    return full.join(steps, F.col("style") == F.col("__style")).select("style", *columns, F.col("__depth").alias("depth"))


def inherited(styles: DataFrame, columns: list[str]) -> DataFrame:
    """(style, columns, depth): each value from the style itself or its nearest ancestor that has one; depth counts its ancestors.

    styles has (style, parent, columns), a style once. A parent that is not there ends a chain. A chain that comes back to
    itself ends there, so a style on a ring has the ring's others as ancestors. Chains may be of any length.
    """
    up = F.col("parent").cast(styles.schema["style"].dataType)
    start = styles.select("style", up.alias("jump"), up.isNotNull().cast("long").alias("depth"), F.lit(False).alias("ring"), *columns)
    known = _resolved(start, columns)
    rings = known.where("ring").select(F.col("style").alias("__ringed"))
    n = rings.count()
    if not n:
        return known.select("style", *columns, "depth")
    ringed = start.join(rings, F.col("style") == F.col("__ringed")).select("style", "jump", "depth", F.col("style").alias("least"), *columns)
    on = _on_rings(ringed, columns, math.ceil(math.log2(max(2, n))) + 1)
    return known.where("not ring").select("style", *columns, "depth").unionByName(on)


def cascaded(styles: DataFrame, columns: list[str], defaults: dict[str, Column]) -> DataFrame:
    """inherited(), with defaults where neither a style nor an ancestor has a value."""
    found = inherited(styles, columns)
    return found.select("style", *[F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in columns], "depth")
