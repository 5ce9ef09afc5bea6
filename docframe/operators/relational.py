"""The relational work inside document conversion: lookups, islands, counters, inheritance, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: Ranges that rows are cut into, at most.
MOST_RANGES = 256


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `__part`: the number of the range of the first order column, a number, date or time, in which a row lies.

    Borders are approximate quantiles, taken once, so that every use of the result sees the same ranges. A large group
    spreads over as many tasks as there are ranges.
    """
    n = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    borders = df.agg(F.percentile_approx(order[0], [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0]
    borders = sorted(set(borders or []))
    if not borders:
        return df.withColumn("__part", F.lit(0))
    # no lambda: Spark's optimizer copies conditions with lambdas to the other side of a join, where their columns are not
    at = F.array_position(F.sort_array(F.array_append(F.lit(borders).cast(T.ArrayType(df.schema[order[0]].dataType)), F.col(order[0]))), F.col(order[0]))
    return df.withColumn("__part", F.coalesce(at.cast("int") - 1, F.lit(0)))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """df with the place of each row in its group, from 1.

    Rows are numbered inside ranges; a range starts after the group's rows in ranges before, of which there is one count each.
    """
    parts = ranged(df, order)
    before = F.sum("count").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.groupBy(*by, "__part").count().select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = parts.withColumn(name, F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("__part") == F.col("__of")]
    return inside.join(starts, same).select(*df.columns, (F.col(name) + F.col("__before")).alias(name))


def merge_runs(df: DataFrame, by: list[str], order: list[str], style: str, text: str) -> DataFrame:
    """Adjacent rows of equal style as one: (by, run, style, text, n), text joined in order.

    Runs are made inside ranges of rows. The borders of a group's ranges, one row for each, then say which run goes on in
    the next range, and pieces of it are joined: no task holds a group, only a run.
    """
    parts = ranged(df, order)
    w = Window.partitionBy(*by, "__part").orderBy(*order)
    new = (~F.col(style).eqNullSafe(F.lag(style).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = parts.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = lambda key, piece: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, piece))), lambda p: p["piece"]), "")
    pieces = runs.groupBy(*by, "__part", "run").agg(F.first(style).alias(style), ordered(order, F.col(text).alias("piece")).alias("piece"), F.count("*").alias("n"))
    borders = pieces.groupBy(*by, "__part").agg(F.max("run").alias("runs"), F.min_by(style, "run").alias("head"), F.max_by(style, "run").alias("tail"))
    row = Window.partitionBy(*by).orderBy("__part")
    goes_on = (F.lag(F.lit(1)).over(row).isNotNull() & F.col("head").eqNullSafe(F.lag("tail").over(row))).cast("int")
    borders = borders.withColumn("on", goes_on).withColumn("own", F.col("runs") - F.col("on"))
    shift = F.coalesce(F.sum("own").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("on")
    shifts = borders.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__of"), shift.alias("shift"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("__part") == F.col("__of")]
    placed = pieces.join(shifts, same).withColumn("run", F.col("run") + F.col("shift"))
    return placed.groupBy(*by, "run").agg(F.first(style).alias(style), ordered(["__part"], "piece").alias(text), F.sum("n").alias("n"))


def suffix_duplicates(df: DataFrame, by: list[str], order: list[str], slug: str) -> DataFrame:
    """df with `anchor`: the slug, with -1, -2 and so on from its second occurrence in by."""
    w = Window.partitionBy(*by, slug).orderBy(*order)
    n = F.row_number().over(w) - 1
    return df.withColumn("anchor", F.when(n == 0, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n.cast("string"))))


def first_seen(df: DataFrame, by: list[str], key: str, *position: str) -> DataFrame:
    """(by, key, place): distinct keys in the order in which they first occur."""
    first = df.groupBy(*by, key).agg(F.min(F.struct(*position)).alias("first"))
    w = Window.partitionBy(*by).orderBy("first") if by else Window.orderBy("first")
    return first.select(*by, key, F.row_number().over(w).alias("place"))


def dominant(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n): the most frequent value, the smallest of equals."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("value"))).alias("best"))
    return best.select(*by, F.col("best.value").alias(value), (-F.col("best.less")).alias("n"))


def first_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group: an aggregate with a partial step, so that nothing is sorted."""
    rest = [c for c in df.columns if c not in by]
    found = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return found.select(*[F.col(c) if c in by else F.col(f"__first.{c}").alias(c) for c in df.columns])


def referenced(definitions: DataFrame, references: DataFrame, on: list[str]) -> DataFrame:
    """Definitions that something refers to."""
    return definitions.join(references.select(*on), on, "left_semi")


def column_widths(cells: DataFrame, by: list[str], column: str, text: str) -> DataFrame:
    """(by, column, width): longest text, between 8 and 40."""
    return cells.groupBy(*by, column).agg(F.greatest(F.lit(8), F.least(F.lit(40), F.max(F.length(text)))).alias("width"))


def chart_table(points: DataFrame, index: str, series: str, value: str, names: list[str]) -> DataFrame:
    """A row for each index from 0 to the largest, a column for each series; null where a series has no point."""
    n = points.agg(F.max(index).alias("n"))
    frame = n.select(F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias(index))
    return frame.join(points.groupBy(index).pivot(series, names).agg(F.first(value)), index, "left")


def padded(rows: DataFrame, by: list[str], cells: str, fill: str = "") -> DataFrame:
    """rows with each list of cells filled up to the longest of its group."""
    widest = rows.groupBy(*by).agg(F.max(F.size(cells)).alias("__width"))
    missing = F.array_repeat(F.lit(fill), F.col("__width") - F.size(cells))
    return rows.join(widest, by).select(*[F.concat(cells, missing).alias(c) if c == cells else F.col(c) for c in rows.columns])


def share_of_max(points: DataFrame, by: list[str], value: str, name: str = "share", least: float = 1.0) -> DataFrame:
    """points with each value as a part of its group's largest, which counts as `least` at least: heights of bars."""
    largest = points.groupBy(*by).agg(F.greatest(F.max(value), F.lit(least)).alias("__max"))
    return points.join(largest, by).withColumn(name, F.col(value) / F.col("__max")).drop("__max")


def running_last(value: Column, by: list[str], order: str) -> Column:
    """The last value that is not null, up to here."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def lines_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, line): the lines of a text column, from 0."""
    return df.select(*keys, F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")).alias("line_no", "line"))


def relationship_targets(references: DataFrame, relationships: DataFrame, by: list[str]) -> DataFrame:
    """references (by, part, rel_id) with `target`: the part or address that the relationship leads to; null without one.

    relationships: (by, rel_id, target, external). Targets start from the part's folder; external ones stay as they are.
    """
    found = references.join(relationships, [*by, "rel_id"], "left")
    folder = F.regexp_replace("part", "[^/]*$", "")
    path = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(folder, "target"))
    return found.select(*references.columns, F.when(F.col("external"), F.col("target")).otherwise(resolve_part(path)).alias("target"))


def resolve_part(path: Column) -> Column:
    """A package part's path without `.` and `..` steps."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    out = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(out, "/")
