"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint holds, bit by bit, the majority of the XXH64 values (seed 42) of a text's word shingles. Fingerprints are
stored as vertical bit planes; distances of 64 pairs at a time are summed by carry-save bitwise counters, which start so
high that they overflow into a flag just beyond the radius, and a block of pairs is left as soon as all are flagged.

The plan is CONTRACT: 64 bits of three-word shingles, radius 3. The bits are cut into five blocks; fingerprints at most three
bits apart agree in two blocks at least, so each of the ten pairs of blocks gives a key, equal keys meet, and no pair is
lost. A key with very many fingerprints is cut (see cells); a cell gives a spanning forest of its links, never its pairs.

Dropping copies asks for a similarity that fingerprints only estimate. There, texts that share a key of their shingle sets
meet, fingerprints of 256 bits (NEAR) leave those that are far apart, and the sets of what is left decide (see jaccard). The
radius is wide: pairs of similarity 0.8 differ in 30 to 50 bits, by 7 deviations less than it at 100 shingles and by 4.6 at
four against five, the worst case; texts that share under 0.4 of their shingles are left apart.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and link like any others; texts of
fewer words than a shingle hash as one shingle; equal texts have equal fingerprints; extra columns are not read; rows of
equal doc_id each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard
from .cells import connect, cut_groups
from .common import free_name, map_text, materialize, row_hash, small, table, unite
from .jaccard import shingle_values

#: A key with more fingerprints than this is compared chunk by chunk.
CELL_ROWS = 8192
#: Connected texts with more rows or shingles than this are compared chunk by chunk.
SET_ROWS, SET_SHINGLES = 1024, 1 << 20
#: Groups up to this size are compared by shifts over many groups at once, larger ones query block by query block.
SMALL_GROUP = 48
#: (first bit, bits) of the five blocks of 64 bits.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass(frozen=True)
class Plan:
    """shingle: words; parts: 64-bit parts of a fingerprint; distinct: whether a shingle counts once; radius: most differing bits."""

    shingle: int
    parts: int
    distinct: bool
    radius: int


CONTRACT = Plan(3, 1, False, 3)
#: For candidates of near copies.
NEAR = Plan(jaccard.WORDS, 4, True, 76)


def fingerprint(data: bytes | None, plan: Plan = CONTRACT) -> np.ndarray:
    """The fingerprint of a UTF-8 text, as plan.parts uint64 numbers. The first part is of the hash values themselves."""
    values = shingle_values(data, plan.shingle)
    return majority(np.unique(values) if plan.distinct else values, plan.parts)


def majority(values: np.ndarray, parts: int) -> np.ndarray:
    """The fingerprint of hash values: bit by bit 1 if over half have it."""
    n = len(values)
    if not n:
        return np.zeros(parts, dtype=np.uint64)
    out = np.empty(parts, dtype=np.uint64)
    for k in range(parts):
        x = values
        if k:
            x = (x + np.uint64(_MIX[0] * k % (1 << 64))) * np.uint64(_MIX[1])
            x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[2])
            x = x ^ (x >> np.uint64(32))
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 1 << 18):
            part = x[at : at + (1 << 18)].astype("<u8")
            counts = np.bincount((part.view(np.uint8).reshape(len(part), 8) + _BYTE_BASE).ravel(), minlength=2048).reshape(8, 256)
            ones += (counts @ _BITS_OF_BYTE).ravel()
        out[k] = int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")
    return out


_BYTE_BASE = (np.arange(8) * 256).astype(np.int64)


def _names(plan: Plan) -> list[str]:
    return [f"fp{k}" for k in range(plan.parts)]


def fingerprints(docs: DataFrame, columns: list[str], plan: Plan = CONTRACT) -> DataFrame:
    """columns of docs beside fp0, fp1 and so on, the fingerprint's parts as signed longs."""
    names = _names(plan)

    def make():
        def work(texts: list[bytes | None]) -> dict[str, object]:
            found = np.array([fingerprint(t, plan) for t in texts], dtype=np.uint64).reshape(len(texts), plan.parts).view(np.int64)
            return {c: np.ascontiguousarray(found[:, k]) for k, c in enumerate(names)}

        return work

    return map_text(docs, columns, ", ".join(f"{c} long" for c in names), make)


def block_keys(fp: Column) -> list[Column]:
    """The ten keys of 64 bits: number of the block pair, then its bits."""
    parts = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for at, n in BLOCKS]
    return [F.lit(t << 26).cast("long") + F.shiftleft(parts[i], BLOCKS[j][1]) + parts[j] for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes of (n, parts) fingerprints: row b holds bit b of all, 64 to a word, with a spare word at the end."""
    n = len(fp)
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    words = (n + 63) // 64 + 1
    out = np.zeros((bits.shape[0], words * 8), dtype=np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def _flags(mask: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, dtype=np.uint8)
    packed = np.packbits(mask, bitorder="little")
    out[: len(packed)] = packed
    return out.view("<u8")


def carry_save(over: np.ndarray, n_planes: int, radius: int, bit_pair) -> np.ndarray:
    """Adds difference planes two at a time into bitwise counters; over gets the pairs of more than radius differing bits.

    bit_pair(b) gives the difference planes b and b + 1. The block is left early once every pair is over.
    """
    width = max(2, (radius + 1).bit_length() if (radius + 1) & radius else radius.bit_length())
    start = (1 << width) - 1 - radius  # counters overflow at radius + 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counter = [np.full_like(over, full if start >> k & 1 else np.uint64(0)) for k in range(width)]
    for b in range(0, n_planes, 2):
        x, y = bit_pair(b)
        u = x ^ y
        carry = (x & y) | (u & counter[0])
        counter[0] ^= u
        for k in range(1, width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % 8 == 6 and b > radius and not (~over).any():
            break
    return over


def link_small(fp: np.ndarray, group: np.ndarray, most: int, radius: int, lab: np.ndarray) -> np.ndarray:
    """Links rows of equal group (adjacent, at most `most` each): row k meets row k + d for every shift d."""
    p, n = planes(fp), len(fp)
    words = p.shape[1] - 1
    for d in range(1, most):
        same = np.zeros(n, dtype=bool)
        same[: n - d] = group[:-d] == group[d:]
        if not same.any():
            break
        skip, shift = divmod(d, 64)
        right, left = np.uint64(shift), np.uint64(63 - shift)

        def moved(b: int, skip=skip, right=right, left=left) -> np.ndarray:
            out = np.zeros(words, dtype=np.uint64)
            near, far = p[b, skip:words], p[b, skip + 1 : words + 1]
            out[: words - skip] = (near >> right) | ((far << left) << np.uint64(1))
            return out

        over = carry_save(~_flags(same, words), len(p), radius, lambda b: (p[b, :words] ^ moved(b), p[b + 1, :words] ^ moved(b + 1)))
        hit = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little"))
        if len(hit):
            lab = unite(lab, hit, hit + d)
    return lab


def link_large(fp: np.ndarray, radius: int, lab: np.ndarray) -> np.ndarray:
    """Labels of one large group, from those that are known: 64 queries at a time against all planes.

    Any pair is either in the largest component or has a row outside, and all rows outside are queried.
    """
    p, n = planes(fp)[:, :-1], len(fp)
    tail = ~_flags(np.ones(n, dtype=bool), p.shape[1])
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    asked = np.zeros(n, dtype=bool)
    while True:
        size = np.bincount(lab, minlength=n)
        largest = size.argmax()
        open_ = np.flatnonzero(~asked & ((lab != largest) | (size[largest] == 1)))
        if not len(open_):
            return lab
        q = open_[:: max(1, len(open_) // 64)][:64]
        asked[q] = True
        part = fp[q]
        spread = [((part[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1))[:, None] * full for b in range(len(p))]
        over = carry_save(np.repeat(tail[None, :], len(q), axis=0), len(p), radius, lambda b: (p[b] ^ spread[b], p[b + 1] ^ spread[b + 1]))
        row, lane = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
        lab = unite(lab, q[row], lane)


def link_sorted(group: np.ndarray, known: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that, with what is known, span what belongs together in each group; rows of a group are adjacent."""
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[cut, len(group)])
    order = np.lexsort((known, group))
    new = np.r_[True, (group[order][1:] != group[order][:-1]) | (known[order][1:] != known[order][:-1])]
    begun = np.empty(len(fp), dtype=np.int64)
    begun[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    lab = begun.copy()
    few = np.repeat((size > 1) & (size <= SMALL_GROUP), size)
    if few.any():
        own = np.flatnonzero(few)
        part = link_small(fp[own], group[own], SMALL_GROUP, radius, np.searchsorted(own, lab[own]))
        lab[own] = own[part]
    for at, n in zip(cut[size > SMALL_GROUP], size[size > SMALL_GROUP]):
        lab[at : at + n] = at + link_large(fp[at : at + n], radius, lab[at : at + n] - at)
    rows = np.arange(len(fp))
    child = np.flatnonzero((begun == rows) & (lab != rows))
    return child, lab[child]


def _compare(plan: Plan):
    """Links of cells; rows (group, cell, known, node, fingerprint) come in order of group and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64)] * (4 + plan.parts)

        def out(group: np.ndarray, cell: np.ndarray, known: np.ndarray, node: np.ndarray, *parts: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])]
            a, b = link_sorted(np.cumsum(new), known, np.stack(parts, axis=1).view(np.uint64), plan.radius)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(len(rest))])
            rows += batch.num_rows
            if rows < 100_000:
                continue
            rest = [np.concatenate([r, *(h[k] for h in held)]) for k, r in enumerate(rest)]
            held, rows = [], 0
            group, cell = rest[:2]
            last = np.flatnonzero((group != group[-1]) | (cell != cell[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield out(*[r[:cut] for r in rest])
                rest = [r[cut:] for r in rest]
        rest = [np.concatenate([r, *(h[k] for h in held)]) for k, r in enumerate(rest)]
        if len(rest[0]):
            yield out(*rest)

    return run


def linked(nodes: DataFrame, keyed: DataFrame, plan: Plan) -> DataFrame:
    """(node, root) of what links within the radius connect, among distinct nodes (node, fp0, ...) that share a key.

    keyed: (group, node), where a group is a key; rows may repeat.
    """
    spark, names = nodes.sparkSession, _names(plan)
    met = keyed.groupBy("group").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    shared = materialize(met.select("group", "n"), "shared")
    members = materialize(keyed.join(shared, "group", "left_semi").distinct(), "members")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compared(dealt: DataFrame) -> DataFrame:
        met = dealt.select("group", F.explode("cells").alias("cell"), "known", "node")
        met = met.withColumn("fp0", F.col("node")) if plan.parts == 1 else met.join(nodes.select("node", *names), "node").select("group", "cell", "known", "node", *names)
        return met.repartition(parts, "group", "cell").sortWithinPartitions("group", "cell").mapInArrow(_compare(plan), "a long, b long")

    return connect(members, cut_groups(shared, F.col("n") / CELL_ROWS), CELL_ROWS, compared)


def classes(prints: DataFrame, first: Column) -> DataFrame:
    """(node, component) for each distinct fingerprint of CONTRACT, which is its own node; component is the smallest
    `first` among all it reaches."""
    nodes = materialize(prints.groupBy(F.col("fp0").alias("node")).agg(F.min(first).alias("least")), "fingerprints")
    found = linked(nodes, nodes.select(F.explode(F.array(*block_keys(F.col("node")))).alias("group"), "node"), CONTRACT)
    rooted = nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return materialize(rooted.join(least, "root").select("node", "component"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    prints = materialize(fingerprints(docs, ["doc_id"]), "prints")
    joined = prints.join(classes(prints, F.col("doc_id")), F.col("fp0") == F.col("node"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _sketch():
    import xxhash

    def work(texts: list[bytes | None]) -> dict[str, object]:
        sets = [jaccard.shingles(t) for t in texts]
        found = [jaccard.keys(s) for s in sets]
        ends = np.r_[0, np.cumsum([len(k) for k in found])].astype(np.int32)
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), jaccard.SEED) for s in sets], dtype=np.uint64).view(np.int64)
        prints = np.array([majority(s, NEAR.parts) for s in sets], dtype=np.uint64).reshape(len(sets), NEAR.parts).view(np.int64)
        columns = {c: np.ascontiguousarray(prints[:, k]) for k, c in enumerate(_names(NEAR))}
        keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
        return {"node": node, "items": np.array([len(s) for s in sets], dtype=np.int64), "keys": keys} | columns

    return work


def _sets():
    return lambda texts: {"shingles": pa.array([jaccard.shingles(t).tobytes() for t in texts], pa.binary())}


def near_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, row_mark, times, kept) of distinct rows (doc_id, row_mark, text): how often each is there, and whether it is
    the one that stays of what near copies connect: the one of the smallest doc_id, null last, then of the least mark."""
    spark, names = rows.sparkSession, _names(NEAR)
    sketched = map_text(rows, ["doc_id", "row_mark"], f"node long, items long, keys array<long>, {', '.join(f'{c} long' for c in names)}", _sketch)
    prints = materialize(sketched, "prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_mark")
    nodes = materialize(prints.groupBy("node").agg(F.min(order).alias("least"), *[F.min(c).alias(c) for c in ("items", *names)]), "nodes")
    found = linked(nodes, prints.select(F.explode("keys").alias("group"), "node"), NEAR)
    near = materialize(found.join(nodes, "node").select(F.col("root").alias("group"), "node", "items", F.col("least.doc_id").alias("own_id"), F.col("least.row_mark").alias("own_mark")), "near")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compared(dealt: DataFrame) -> DataFrame:
        dealt = small(materialize(dealt.select("group", "known", "node", "cells", "own_id", "own_mark"), "dealt"), F.size("cells"))
        texts = rows.join(dealt, (F.col("row_mark") == F.col("own_mark")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
        sets = map_text(texts, ["group", "cells", "known", "node"], "shingles binary", _sets)
        met = sets.select("group", F.explode("cells").alias("cell"), "known", "node", "shingles").repartition(parts, "group", "cell")
        return met.sortWithinPartitions("group", "cell", "node").mapInArrow(jaccard.compare, "a long, b long")

    totals = near.groupBy("group").agg(F.count("*").alias("n"), F.greatest(F.count("*") / SET_ROWS, F.sum("items") / SET_SHINGLES).alias("chunks"))
    joined = connect(near, cut_groups(totals, F.col("chunks")), SET_ROWS, compared)
    rooted = nodes.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    first = rooted.groupBy("root").agg(F.min("least").alias("first"))
    of_node = rooted.join(first, "root").select("node", "first")
    distinct = prints.groupBy("node", "doc_id", "row_mark").agg(F.count("*").alias("times"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_mark") == F.col("first.row_mark"))
    return materialize(distinct.join(of_node, "node").select("doc_id", "row_mark", "times", kept.alias("kept")), "near_copies")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of docs for each group that near copies connect: the one of the smallest doc_id, by row hash among equals.

    Near copies are of similarity 0.8 or more in their five-word shingles. Rows that are equal in every column are one
    document. Texts stay where they are as long as the ids to drop can be broadcast, and are shuffled once beyond that.
    """
    mark, gone_id, gone_mark = (free_name(docs, x) for x in ("row_mark", "gone_id", "gone_mark"))
    marked = docs.select("*", row_hash(docs).alias(mark))
    found = near_copies(marked.select("doc_id", F.col(mark).alias("row_mark"), "text"))
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(mark) == F.col(gone_mark))

    def of(which: str) -> DataFrame:
        return small(found.where(which).select(F.col("doc_id").alias(gone_id), F.col("row_mark").alias(gone_mark)))

    kept = marked.join(of("not kept or times > 1"), same, "left_anti")
    if not found.where("kept and times > 1").isEmpty():
        kept = kept.union(marked.join(of("kept and times > 1"), same, "left_semi").dropDuplicates(["doc_id", mark]))
    return kept.drop(mark)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
