"""Tables as Markdown, CSV and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell_escape, csv_field


def cell_list(columns: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def table_row(cells: Column) -> Column:
    """A line of a Markdown table."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, cell_escape), " | "), F.lit(" |"))


def table_head(names: list[str], alignments: list[str] | None = None) -> str:
    """Header and separator lines of a Markdown table."""
    rule = {"left": ":---", "center": ":---:", "right": "---:"}
    escaped = [n.replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>") for n in names]
    marks = [rule.get(a, "---") for a in alignments or ["none"] * len(names)]
    return f"| {' | '.join(escaped)} |\n| {' | '.join(marks)} |"


def ordered_lines(line: Column, order: list[str]) -> Column:
    """Lines of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda p: p["line"]), "\n")


def markdown_tables(df: DataFrame, by: list[str], columns: list[str], order: list[str], alignments: list[str] | None = None) -> DataFrame:
    """(by, markdown): a Markdown table of the columns for each group."""
    body = ordered_lines(table_row(cell_list(columns)), order)
    return df.groupBy(*by).agg(F.concat(F.lit(table_head(columns, alignments) + "\n"), body).alias("markdown"))


def csv_record(columns: list[str], delimiter: str = ",") -> Column:
    """A CSV record of the columns."""
    return F.concat_ws(delimiter, *[csv_field(F.coalesce(F.col(c).cast("string"), F.lit("")), delimiter) for c in columns])


def row_cells(line: Column) -> Column:
    """Cells of a Markdown table line: outer bars dropped, escapes undone, `<br>` as line breaks, trimmed."""
    bare = F.regexp_replace(F.trim(line), r"^\|+|(?<!\\)\|+$", "")
    parts = F.regexp_extract_all(F.concat(bare, F.lit("|")), F.lit(r"((?:\\.|[^|\\])*)\|"), F.lit(1))
    return F.transform(parts, lambda p: F.trim(F.replace(F.regexp_replace(p, r"\\([|\\])", "$1"), F.lit("<br>"), F.lit("\n"))))


def is_separator(line: Column) -> Column:
    """Whether a line is a Markdown table's separator."""
    return line.rlike(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$")
