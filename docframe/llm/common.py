"""What the corpus operators share: tables, shared storage, Arrow plumbing, deterministic fractions and components."""

from __future__ import annotations

import ctypes
import gc
import re
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no shared folder, as in tests.
FALLBACK_SHARED = "/tmp/checkpoints"
#: Arrow batches are cut to about so many bytes of text before a step works on them.
CHUNK_BYTES = 4 << 20
#: Rows that Spark hands to Python at once: texts may be long, and batches are held on both sides.
BATCH_ROWS = 1000
#: Rows of ids, of some tens of bytes each, that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Edges, of 16 bytes each, that one task joins at most.
ONE_TASK_EDGES = 1 << 18
#: What a worker keeps from task to task. Steps that have no use for it drop it.
CACHES: list[dict] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or FALLBACK_SHARED).rstrip("/")


#: By thread, so that queries that run side by side in one driver never delete each other's tables.
_RUN = threading.local()


def written() -> list[str]:
    """Folders of the tables that materialize() has written in this thread and nothing has deleted."""
    if not hasattr(_RUN, "written"):
        _RUN.written = []
    return _RUN.written


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back.

    That cuts the lineage as checkpoint() does, but computes df only once, and files keep column statistics. What reads the
    table is lazy, so it stays until remove() or remove_since() is told that nothing needs it.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/docframe-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    written().append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_since(spark: SparkSession, begun: int, keep: int = 0) -> None:
    """Deletes the tables of this thread written since written() had `begun` entries, but for the last `keep`."""
    folders = written()
    end = len(folders) - keep
    for folder in folders[begun:end]:
        remove(spark, folder)
    del folders[begun:end]


def small(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """df, a written table of ids, marked for broadcast if its rows weigh at most BROADCAST_ROWS; a larger one is shuffled."""
    return F.broadcast(df) if (df.agg(F.count("*") if weight is None else F.sum(weight)).first()[0] or 0) <= BROADCAST_ROWS else df


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents that no label may be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fraction(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, for telling rows of equal ids apart."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in df.schema])


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def binary_values(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text, so that memory follows the longest text and not the batch."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        if batch.num_rows == 0:
            continue
        if batch.column(k).nbytes <= CHUNK_BYTES:
            yield batch
            continue
        import pyarrow.compute as pc

        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK_BYTES)))
            yield batch.slice(start, stop - start)
            start = stop


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows and CHUNK_BYTES bytes, where they are larger."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size) != f"{CHUNK_BYTES}b":
        spark.conf.set(size, f"{CHUNK_BYTES}b")


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def drop_caches() -> None:
    """Drops what earlier steps have left in this Python worker."""
    if any(CACHES):
        for c in CACHES:
            c.clear()
        trim()


def map_text(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[list[bytes | None]], dict[str, object]]]) -> DataFrame:
    """columns of df beside what a function makes of the text, batch by batch.

    make() runs once per task and returns a function from texts to the new columns, so models load once.
    """
    given = df.select(*columns, "text")
    kept = [f for f in given.schema if f.name in columns]
    out = T.StructType([*kept, *T._parse_datatype_string(schema)])
    names = [f.name for f in out]

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        work = make()
        for batch in chunks(batches):
            made = work(binary_values(batch.column(batch.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) if c in columns else as_array(made[c]) for c in names], names=names)
        trim()  # the worker lives on

    return given.mapInArrow(run, out)


def as_array(values: object) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def filter_text(docs: DataFrame, make: Callable[[], Callable[[list[bytes | None]], np.ndarray]], column: str = "text") -> DataFrame:
    """The rows of docs whose text a function keeps, with all their columns."""
    k = docs.columns.index(column)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        keep = make()
        for batch in batches:
            for part in chunks(iter([batch]), column):
                yield part.filter(pa.array(keep(binary_values(part.column(k)))))
        trim()  # the worker lives on

    return docs.mapInArrow(run, docs.schema)


def unite(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[k] and b[k]; lab holds each item's smallest known member and is flat before and after."""
    while True:
        x, y = lab[a], lab[b]
        open_ = x != y
        if not open_.any():
            return lab
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
        while True:
            flat = lab[lab]
            if (flat == lab).all():
                break
            lab = flat


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces edges (a, b) by one edge per node to the smallest node of its part, among each batch's edges."""
    for batch in batches:
        if batch.num_rows:
            yield _forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    lab = unite(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    own = np.flatnonzero(lab != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[lab[own]])], names=["a", "b"])


def _whole_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
    if held:
        yield _forest(*map(np.concatenate, zip(*held)))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), both long; root is the component's smallest node.

    Alternating large-star and small-star rounds: each node of a pair points to the smallest neighbour, until only stars
    are left. A node with very many neighbours is met by aggregates with a partial step and by joins that adaptive
    execution may split, never by one task that holds its neighbourhood. Up to ONE_TASK_EDGES are joined in one task.
    """
    begun = len(written())
    forest = edges.where("a <> b").select("a", "b").mapInArrow(local_forest, "a long, b long")
    pairs = materialize(forest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    few = pairs.count() <= ONE_TASK_EDGES
    if few:
        pairs = materialize(pairs.coalesce(1).mapInArrow(_whole_forest, "a long, b long"), "edges")
        remove_since(edges.sparkSession, begun, keep=1)
    for _ in range(0 if few else most_rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
        large = pairs.join(least, pairs.b == least.node).select("a", F.least("b", "m").alias("b")).distinct()
        parent = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
        down = large.join(parent, large.a == parent.node).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = materialize(down.union(parent.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        again = pairs.select(F.col("b").alias("node")).distinct().join(pairs.select(F.col("a").alias("node")), "node", "left_semi")
        remove_since(edges.sparkSession, begun, keep=1)  # the round before
        total, distinct = pairs.agg(F.count("*"), F.countDistinct("a")).first()
        if total == distinct and again.isEmpty():
            break
    else:
        if not few:
            raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
