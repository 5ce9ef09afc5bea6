"""Typed cells: empty, integer, float, string, boolean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 9223372036854775807


def whole(x: Column) -> Column:
    """Whether a number has no fraction and fits a 64-bit integer."""
    return (x == F.floor(x)) & (x >= F.lit(-9.223372036854775e18)) & (x < F.lit(9.223372036854775e18))


def float_kind(x: Column) -> Column:
    """The kind of cell that a float becomes: a whole one is an integer."""
    return F.when(x.isNull(), "empty").when(whole(x), "integer").otherwise("float")


def float_text(x: Column) -> Column:
    """A float as cell text: whole numbers without a point, no exponent, shortest digits otherwise."""
    shortest = x.cast("string")
    plain = F.when(shortest.contains("E"), F.regexp_replace(x.cast("decimal(38,17)").cast("string"), r"\.?0+$", "")).otherwise(shortest)
    return F.when(whole(x), x.cast("bigint").cast("string")).otherwise(plain)


def json_kind(x: Column) -> Column:
    """The kind of cell that a JSON text becomes; nested values are strings."""
    v = F.trim(x)
    return (
        F.when(v.isNull() | (v == "null"), "empty").when(v.isin("true", "false"), "boolean").when(v.rlike("^-?[0-9]+$") & v.try_cast("bigint").isNotNull(), "integer")
        .when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), "float").otherwise("string")
    )


def column_width(longest: Column) -> Column:
    """Width of a spreadsheet column by its longest text."""
    return F.greatest(F.lit(8), F.least(F.lit(40), longest))
