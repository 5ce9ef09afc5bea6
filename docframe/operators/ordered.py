"""Ordered work on groups of any size: rows are cut into ranges of their order, and only borders of ranges meet.

`order` is a number, date or time that tells the rows of a group apart. A group's ranges are at most relational.MOST_RANGES,
so what is gathered by group is bounded by that, and no task holds a group.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .batches import Run, through
from .inheritance import written
from .relational import numbered, ranged

#: Rows of a group that is not cut into ranges.
WHOLE_ROWS = 20_000


def with_border(df: DataFrame, borders: DataFrame, by: list[str]) -> DataFrame:
    """df with the other columns of borders, by equal `by` and range; nulls are equal."""
    named = borders.select(*[F.col(c).alias(f"__b_{c}") for c in [*by, "__part"]], *[c for c in borders.columns if c not in [*by, "__part"]])
    return df.join(named, [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in [*by, "__part"]], "left").drop(*[f"__b_{c}" for c in [*by, "__part"]])


def _over_ranges(df: DataFrame, by: list[str], order: str, inside: Callable[[object], Column], border: Column, before: Callable[[object], Column], both: Callable[[Column, Column], Column], name: str) -> DataFrame:
    parts = ranged(df, [order])
    rows = parts.withColumn("__inside", inside(Window.partitionBy(*by, "__part").orderBy(order)))
    borders = parts.groupBy(*by, "__part").agg(border.alias("__border"))
    carried = borders.withColumn("__before", before(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).drop("__border")
    return with_border(rows, carried, by).withColumn(name, both(F.col("__inside"), F.col("__before"))).drop("__inside", "__before", "__part")


def last_known(df: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """df with the last value that is not null, up to each row."""
    return _over_ranges(
        df.withColumn("__value", value), by, order, lambda w: F.last("__value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))), lambda w: F.last("__border", ignorenulls=True).over(w), F.coalesce, name,
    ).drop("__value")


def sum_before(df: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """df with the sum of the value over the rows before each row."""
    zero = F.lit(0).cast("long")
    return _over_ranges(
        df.withColumn("__value", value), by, order, lambda w: F.coalesce(F.sum("__value").over(w.rowsBetween(Window.unboundedPreceding, -1)), zero),
        F.sum("__value"), lambda w: F.coalesce(F.sum("__border").over(w), zero), lambda a, b: a + b, name,
    ).drop("__value")


def _keys(columns: list[pa.Array]) -> Iterator[tuple]:
    """Rows of columns as tuples that are equal where a grouping takes them for equal."""
    return zip(*[["nan" if v != v else v for v in c.to_pylist()] for c in columns], strict=True)


def _stacked(by: list[str], order: str, level: str) -> Callable[[T.StructType], tuple[Run, T.StructType]]:
    """Parents and numbers of rows inside ranges, by a stack of (level, order, number), as a step of sorted batches.

    The last row of a range also has what is left: the stack as `__ends`, and the levels of rows without a parent there as
    `__open`. Rows without a level have no parent, and are numbered by themselves.
    """

    def step(given: T.StructType) -> tuple[Run, T.StructType]:
        lv, at = given[level].dataType, given[order].dataType
        end = T.StructType([T.StructField("level", lv), T.StructField("at", at), T.StructField("number", T.LongType())])
        schema = T.StructType([*given, T.StructField("parent", at), T.StructField("number", T.LongType()), T.StructField("__ends", T.ArrayType(end)), T.StructField("__open", T.ArrayType(lv))])
        types = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, stack, open_, blank = None, [], {}, 0

            def left() -> tuple[list[dict], list[object]]:
                ends = [{"level": lv, "at": at, "number": n} for lv, at, n in stack]
                return (ends + [{"level": None, "at": None, "number": blank}] if blank else ends), list(open_) + [None] * (blank > 0)

            held: pa.RecordBatch | None = None  # a range's last row is known by the next batch's first
            for batch in batches:
                if not batch.num_rows:
                    continue
                parents, numbers, ends, opens = [], [], [None] * batch.num_rows, [None] * batch.num_rows
                for k, (key, at, lv) in enumerate(zip(_keys([batch[c] for c in [*by, "__part"]]), batch[order].to_pylist(), batch[level].to_pylist(), strict=True)):
                    if key != before:
                        if k:
                            ends[k - 1], opens[k - 1] = left()
                        elif held is not None:
                            yield _closed(held, *left())
                            held = None
                        before, stack, open_, blank = key, [], {}, 0
                    if lv is None:
                        blank += 1
                        parents.append(None)
                        numbers.append(blank)
                        continue
                    n = 1
                    while stack and stack[-1][0] >= lv:
                        last, _, m = stack.pop()
                        if last == lv:
                            n = m + 1
                    parents.append(stack[-1][1] if stack else None)
                    numbers.append(n)
                    if not stack:
                        open_[lv] = None
                    stack.append((lv, at, n))
                if held is not None:
                    yield held
                made = [pa.array(v, types.field(c).type) for c, v in (("parent", parents), ("number", numbers), ("__ends", ends), ("__open", opens))]
                held = pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)
            if held is not None:
                yield _closed(held, *left())

        return run, schema

    return step


def _closed(batch: pa.RecordBatch, ends: list[dict], opens: list[object]) -> pa.RecordBatch:
    """batch with what is left of its last row's range."""
    columns = [pa.array([*c.to_pylist()[:-1], v], c.type) for c, v in zip(batch.columns[-2:], (ends, opens), strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=batch.schema.names)


def _carried(by: list[str]) -> Callable[[T.StructType], tuple[Run, T.StructType]]:
    """(by, __part, level, __up, __more): what ranges before say to a range's rows without a parent, from sorted rows of ranges."""

    def step(given: T.StructType) -> tuple[Run, T.StructType]:
        end = given["__ends"].dataType.elementType
        schema = T.StructType([*[given[c] for c in [*by, "__part"]], T.StructField("__level", end["level"].dataType), T.StructField("__up", end["at"].dataType), T.StructField("__more", T.LongType())])
        types = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, stack, blank = None, [], 0
            for batch in batches:
                rows: list[int] = []
                out: list[tuple] = []
                for k, (key, ends, opens) in enumerate(zip(_keys([batch[c] for c in by]) if by else [()] * batch.num_rows, batch["__ends"].to_pylist(), batch["__open"].to_pylist(), strict=True)):
                    if key != before:
                        before, stack, blank = key, [], 0
                    for lv in opens if stack or blank else ():
                        if lv is None:
                            answer = (None, None, blank)
                        else:
                            place = bisect_left(stack, lv, key=lambda s: s[0])
                            more = stack[place][2] if place < len(stack) and stack[place][0] == lv else 0
                            answer = (lv, stack[place - 1][1] if place else None, more)
                        rows.append(k)
                        out.append(answer)
                    own = [(e["level"], e["at"], e["number"]) for e in ends if e["level"] is not None]
                    blank += sum(e["number"] for e in ends if e["level"] is None)
                    if own:  # its least level ends what is not less, and goes on counting in the list of that level
                        place = bisect_left(stack, own[0][0], key=lambda s: s[0])
                        more = stack[place][2] if place < len(stack) and stack[place][0] == own[0][0] else 0
                        stack = [*stack[:place], (own[0][0], own[0][1], own[0][2] + more), *own[1:]]
                if rows:
                    made = [pa.array([o[x] for o in out], types.field(c).type) for x, c in enumerate(("__level", "__up", "__more"))]
                    yield pa.RecordBatch.from_arrays([*[batch[c].take(pa.array(rows)) for c in [*by, "__part"]], *made], names=schema.names)

        return run, schema

    return step


def _outlined(df: DataFrame, by: list[str], order: str, level: str) -> DataFrame:
    """df with `parent` and `number`.

    Groups of up to WHOLE_ROWS rows stay whole. Larger ones are cut into ranges: a stack finds what is inside a range, is
    written once, and what stacks have left at the ends of ranges answers rows whose parent or list began before.
    """
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > WHOLE_ROWS)
    large = written(sizes.select(*[F.col(c).alias(f"__l_{c}") for c in by], F.lit(True).alias("__large")))
    cut = not large.isEmpty()
    if cut:
        parts = ranged(df.join(large, [F.col(c).eqNullSafe(F.col(f"__l_{c}")) for c in by] or F.lit(True), "left").drop(*[f"__l_{c}" for c in by]), [order])
        parts = parts.withColumn("__part", F.when(F.col("__large"), F.col("__part")).otherwise(F.lit(0))).drop("__large")
    else:
        parts = df.withColumn("__part", F.lit(0))
    sorted_ = parts.repartition(*by, "__part").sortWithinPartitions(*by, "__part", F.col(order).asc_nulls_last())
    inside = through(sorted_, _stacked(by, order, level))
    if not cut:
        return inside.select(*df.columns, "parent", "number")
    inside = written(inside)
    ends = inside.where("__ends is not null").select(*by, "__part", "__ends", "__open")
    near = ends.repartition(*by) if by else ends.repartition(1)  # a row for each range, of which there are at most MOST_RANGES
    answers = written(through(near.sortWithinPartitions(*by, "__part"), _carried(by)))
    named = answers.select(*[F.col(c).alias(f"__a_{c}") for c in [*by, "__part"]], "__level", "__up", "__more")
    same = [F.col(c).eqNullSafe(F.col(f"__a_{c}")) for c in [*by, "__part"]] + [F.col(level).eqNullSafe(F.col("__level")), F.col("parent").isNull()]
    return inside.join(named, same, "left").select(*df.columns, F.coalesce("parent", "__up").alias("parent"), (F.col("number") + F.coalesce("__more", F.lit(0))).alias("number"))


def outline_parents(df: DataFrame, by: list[str], order: str, level: str) -> DataFrame:
    """df with `parent`: the order of the last row before that has a smaller level; null at the top, and for a null level.

    A stack finds it inside a range, and the stacks that ranges before have left, each as long as a range has levels, tell the rest.
    """
    return _outlined(df, by, order, level).drop("number")


def list_numbers(df: DataFrame, by: list[str], order: str, level: str) -> DataFrame:
    """df with `number`: the item's number in its list; a shallower item starts deeper lists anew. Items of one list have one parent and level.

    The item before in a list is the one of its level that a stack gives up for it, so parents and numbers take one pass.
    """
    return _outlined(df, by, order, level).drop("parent")


def expand_runs(rows: DataFrame, by: list[str], order: str, repeat: str = "repeat", cells: str = "cells") -> DataFrame:
    """(by, row, cells): rows from 1 of runs of equal rows, whose cells are runs (value, repeat) too.

    Blank cells at a row's end are cut before anything is expanded, and a run of blank rows only moves what follows, so it
    costs one row, however long.
    """
    value = lambda c: c["value"].isNotNull()
    behind = F.array_position(F.transform(F.reverse(cells), value), F.lit(True))
    own = F.when(behind > 0, F.slice(cells, F.lit(1), (F.size(cells) - behind + 1).cast("int")))
    placed = sum_before(rows.select(*by, order, repeat, own.alias("__own")), by, order, F.col(repeat).cast("long"), "__start")
    each = placed.where("__own is not null").withColumn("row", F.explode(F.sequence(F.col("__start") + 1, F.col("__start") + F.col(repeat))))
    return each.select(*by, "row", F.flatten(F.transform("__own", lambda c: F.array_repeat(c["value"], c["repeat"].cast("int")))).alias(cells))


def positional_diff(old: DataFrame, new: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """(by, number, old, new, change): the n-th text of a group against the n-th: unchanged, edited, added or removed.

    A group with added or removed rows has changed in structure; `structural` says so on each of its rows.
    """
    left = numbered(old.select(*by, order, text), by, [order]).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("number").alias("__number"), F.col(text).alias("old"), F.lit(True).alias("__l"))
    right = numbered(new.select(*by, order, text), by, [order]).select(*by, "number", F.col(text).alias("new"), F.lit(True).alias("__r"))
    both = left.join(right, [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in by] + [F.col("__number") == F.col("number")], "full")
    change = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("edited")
    rows = both.select(*[F.when(F.col("__r").isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in by], F.coalesce("number", "__number").alias("number"), "old", "new", change.alias("change"))
    moved = rows.where(F.col("change").isin("added", "removed")).select(*[F.col(c).alias(f"__m_{c}") for c in by]).distinct().withColumn("__moved", F.lit(True))
    marked = rows.join(moved, [F.col(c).eqNullSafe(F.col(f"__m_{c}")) for c in by], "left")
    return marked.select(*rows.columns, F.coalesce("__moved", F.lit(False)).alias("structural"))


def merged_cells(cells: DataFrame, by: list[str], row: str, cell: str, span: str, merge: str) -> DataFrame:
    """(by, row, cell, column, colspan, rowspan) of the cells that a table shows.

    span: columns of the grid that a cell takes; merge: restart, continue or null. A cell's column is the sum of the spans
    before it. A continued cell goes on with what was last at its column: it is hidden below a merge, and counts for that
    one's rows; otherwise it stays.
    """
    w = Window.partitionBy(*by, row).orderBy(cell)  # a table's row
    wide = F.greatest(F.col(span).cast("long"), F.lit(1).cast("long"))
    grid = cells.withColumn("__span", wide).withColumn("column", F.coalesce(F.sum("__span").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    taken = F.when(F.col(merge) == "continue", F.array("column")).otherwise(F.sequence(F.col("column"), F.col("column") + F.col("__span") - 1))
    each = grid.withColumn("__at", F.explode(taken))
    origin = F.when(F.coalesce(F.col(merge), F.lit("")) != "continue", F.struct((F.coalesce(F.col(merge), F.lit("")) == "restart").alias("open"), F.col(row).alias("row"), F.col(cell).alias("cell")))
    known = last_known(each, [*by, "__at"], row, origin, "__origin")
    hidden = known.where(f"{merge} = 'continue' and __origin.open")
    counts = hidden.groupBy(*by, F.col("__origin.row").alias("__row"), F.col("__origin.cell").alias("__cell")).agg(F.count("*").alias("__more"))
    keys = [*by, row, cell]
    gone = hidden.select(*[F.col(c).alias(f"__g_{c}") for c in keys])
    named = counts.select(*[F.col(c).alias(f"__c_{c}") for c in by], "__row", "__cell", "__more")
    shown = grid.join(gone, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in keys], "left_anti")
    full = shown.join(named, [F.col(c).eqNullSafe(F.col(f"__c_{c}")) for c in by] + [F.col(row) == F.col("__row"), F.col(cell) == F.col("__cell")], "left")
    return full.select(*[F.col(c) for c in cells.columns if c not in (span, merge)], "column", F.col("__span").alias("colspan"), (F.coalesce("__more", F.lit(0)) + 1).alias("rowspan"))
