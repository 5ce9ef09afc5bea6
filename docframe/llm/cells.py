"""Connecting the rows of groups, in cells of bounded size, whatever a group holds.

A group of up to `most` rows is one cell. A larger one is cut into chunks, and a few rows that a hash picks sit in every
chunk and tie the chunks' parts together. What then lies outside a group's largest part, mostly nothing, meets all chunks of
its group in a second round. So all pairs of a group are compared or connected already, and rows dealt grow with the group
and with what is loose in it, not with the square of the group.

Defined results: a row by itself connects with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

#: Rows that sit in every chunk of a cut group, about.
TIES = 16


def cut_groups(totals: DataFrame, parts: Column) -> DataFrame:
    """(group, n, chunks) of groups (group, n) that need several chunks; parts: how many, as a fraction."""
    return totals.select("group", "n", F.ceil(parts).cast("int").alias("chunks")).where(F.col("chunks") > 1)


def _first(members: DataFrame, hot: DataFrame) -> DataFrame:
    chunk = F.pmod(F.xxhash64("node", "group"), F.col("chunks")).cast("int")
    tie = F.pmod(F.xxhash64(F.lit("tie"), "node", "group"), F.col("n")) < TIES
    cells = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).when(tie, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk))
    return members.join(hot, "group", "left").select(*members.columns, F.col("node").alias("known"), cells.alias("cells"))


def _second(members: DataFrame, hot: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """Rows of groups in which something is loose; loose rows go to blocks, and each block meets each chunk."""
    own = members.join(hot, "group").join(found, "node", "left").select(*members.columns, "chunks", F.coalesce("root", "node").alias("known"))
    parts = own.groupBy("group", "known").count().groupBy("group")
    loose = parts.agg(F.max_by("known", "count").alias("main"), (F.sum("count") - F.max("count")).alias("loose")).where("loose > 0")
    blocks = F.ceil(F.col("loose") / most).cast("int")
    chunk = F.pmod(F.xxhash64("node", "group"), F.col("chunks")).cast("int")
    block = F.pmod(F.xxhash64(F.lit("block"), "node", "group"), F.col("blocks")).cast("int")
    all_blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: chunk * F.col("blocks") + b)
    all_chunks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c * F.col("blocks") + block)
    cells = F.when(F.col("known") == F.col("main"), all_blocks).otherwise(F.array_union(all_blocks, all_chunks))
    met = own.join(loose.withColumn("blocks", blocks), "group")
    return met.select(*members.columns, "known", cells.alias("cells"))


def connect(members: DataFrame, hot: DataFrame, most: int, compared: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the nodes that links inside groups connect, as components() gives them.

    members: (group, node, ...); hot: see cut_groups. compared() gets members with `known` (rows of a group with equal
    numbers are connected) and `cells` (numbers of the group's cells that the row is compared in), and gives links (a, b)
    that connect, with what is known, what belongs together in each cell.
    """
    hot = materialize(hot, "hot")
    links = materialize(compared(_first(members, hot)), "links")
    found = components(links)
    if hot.isEmpty():
        return found
    again = materialize(_second(members, hot, found, most), "loose")
    if again.isEmpty():
        return found
    return components(links.union(materialize(compared(again), "links")))
