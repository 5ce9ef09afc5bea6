"""Document trees as rows: one for each block, list item, cell and inline, in document order by path."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import markdown as M
from .batches import Run, Step, picking, pieces, through

_FIELDS = [("node_id", pa.int32()), ("parent_id", pa.int32()), ("path", pa.list_(pa.int32())), ("depth", pa.int32()), ("scope", pa.string()), ("kind", pa.string()), ("level", pa.int32()), ("ordered", pa.bool_()), ("number", pa.int64()), ("checked", pa.bool_()), ("text", pa.string()), ("destination", pa.string()), ("label", pa.string()), ("alignment", pa.string()), ("row_idx", pa.int32()), ("col_idx", pa.int32())]
_SCHEMA = "node_id int, parent_id int, path array<int>, depth int, scope string, kind string, level int, ordered boolean, number long, checked boolean, text string, destination string, label string, alignment string, row_idx int, col_idx int"
#: Blocks that hold other blocks.
PARENTS = ("list", "list_item", "quote", "footnote_definition")


def flat(blocks: list[dict]) -> list[dict]:
    """Nodes of a tree in document order."""
    out: list[dict] = []

    def add(parent: int | None, path: list[int], scope: str, kind: str, **more: object) -> int:
        out.append({"node_id": len(out), "parent_id": parent, "path": path, "depth": len(path), "scope": scope, "kind": kind, **more})
        return len(out) - 1

    def inlines(items: list[dict], parent: int, path: list[int]) -> None:
        for k, i in enumerate(items):
            at = [*path, k]
            me = add(parent, at, "inline", i["type"], text=i.get("text") or i.get("alt") or i.get("html"), destination=i.get("destination"), label=i.get("label") or i.get("name"), checked=i.get("checked"))
            inlines(i.get("content", []), me, at)

    def many(items: list[dict], parent: int | None, path: list[int]) -> None:
        for k, b in enumerate(items):
            at = [*path, k]
            me = add(parent, at, "block", b["type"], level=b.get("level"), ordered=b.get("ordered"), number=b.get("start"), text=b.get("text") or b.get("code") or b.get("html"), label=b.get("label"))
            inlines(b.get("content", []), me, at)
            many(b.get("blocks", []), me, at)
            for j, i in enumerate(b.get("items", [])):
                many(i["blocks"], add(me, [*at, j], "list_item", "list_item", number=i.get("number")), [*at, j])
            sides = b.get("alignments", [])
            rows = b.get("cells") or [[[{"type": "text", "text": c}] for c in r] for r in b.get("rows") or []] if b["type"] == "table" else []
            for y, row in enumerate(rows):
                line = add(me, [*at, y], "table_row", "table_row", row_idx=y)
                for x, cell in enumerate(row):
                    inlines(cell, add(line, [*at, y, x], "table_cell", "table_cell", row_idx=y, col_idx=x, alignment=sides[x] if x < len(sides) else None, text=M.plain(cell)), [*at, y, x])

    many(blocks, None, [])
    return out


def of_markdown(df: DataFrame, keys: list[str], markdown: str = "markdown", before: tuple[Step, ...] = ()) -> DataFrame:
    """(keys, node columns) for each node of each document; before: steps that make the Markdown from df, in the same worker."""
    there = picking([*keys, markdown], lambda b: pc.is_valid(b[markdown]))
    return through(df if before else df.select(*keys, markdown), *before, there, _flattening)


def _flattening(given: T.StructType) -> tuple[Run, T.StructType]:
    schema = T.StructType([*given[:-1], *T._parse_datatype_string(_SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, -1):
            trees = [flat(M.parse(t)) for t in part.column(part.num_columns - 1).to_pylist()]
            owner = pa.array([k for k, t in enumerate(trees) for _ in t], pa.int64())
            nodes = [n for t in trees for n in t]
            yield pa.RecordBatch.from_arrays([*[c.take(owner) for c in part.columns[:-1]], *[pa.array([n.get(f) for n in nodes], t) for f, t in _FIELDS]], names=schema.names)

    return run, schema


def with_counts(df: DataFrame, kinds: list[str], markdown: str = "markdown", before: tuple[Step, ...] = ()) -> DataFrame:
    """df with n_<kind> for each of kinds and plain_text_chars, counted in the row's own tree: no rows meet.

    before: steps that make the Markdown from df, in the same worker.
    """
    return through(df, *before, lambda schema: _counting(schema, kinds, markdown))


def _counting(given: T.StructType, kinds: list[str], markdown: str) -> tuple[Run, T.StructType]:
    schema = T.StructType([*given, *[T.StructField(f"n_{k}", T.LongType()) for k in kinds], T.StructField("plain_text_chars", T.LongType())])
    at = given.names.index(markdown)

    def counted(text: str | None) -> list[int | None]:
        if text is None:
            return [None] * (len(kinds) + 1)
        nodes = flat(M.parse(text))
        own = Counter(n["kind"] for n in nodes)
        return [*[own[k] for k in kinds], sum(len(n.get("text") or "") for n in nodes if n["kind"] in ("text", "code", "math"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            made = [counted(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([m[k] for m in made], pa.int64()) for k in range(len(kinds) + 1)]], names=schema.names)

    return run, schema


def tables_only(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Tables with all below them, and the lists, items, quotes and footnotes above them.

    A node below a table has a table's path as prefix, and one above a table is a prefix of its path: prefixes are
    exploded and met by equality, so no pairs of nodes are compared.
    """
    tables = nodes.where("kind = 'table'").select(*keys, "path")
    prefix = lambda df: df.select(*keys, "node_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("path"))
    below = prefix(nodes).join(tables, [*keys, "path"], "left_semi").select(*keys, "node_id")
    above = nodes.where(F.col("kind").isin(*PARENTS)).join(prefix(nodes.where("kind = 'table'")).select(*keys, "path").distinct(), [*keys, "path"], "left_semi").select(*keys, "node_id")
    return nodes.join(below.union(above).distinct(), [*keys, "node_id"], "left_semi")


def plain_text(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, plain): text of all leaves in document order."""
    piece = F.when(F.col("kind").isin("soft_break", "hard_break"), " ").when(F.col("kind") == "footnote_reference", F.concat(F.lit("[^"), "label", F.lit("]"))).when(F.col("kind").isin("text", "code", "math", "image"), F.col("text"))
    leaves = nodes.where("scope = 'inline'").select(*keys, "node_id", piece.alias("piece")).where("piece is not null")
    return leaves.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "piece"))), lambda p: p["piece"]), "").alias("plain"))
