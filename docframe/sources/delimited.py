"""Delimited text by Spark's own reader: a header, quoted fields, and records of one length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column for a record that is kept though it is broken.
CORRUPT = "_corrupt_record"


def read(spark: SparkSession, path: str, delimiter: str = ",", schema: str | None = None, mode: str = "FAILFAST", header: bool = True, line_breaks: bool = True) -> DataFrame:
    """Records as rows, text unless a schema says otherwise; an empty field is an empty text.

    A record with too few or too many fields, or with a field that its type can't hold, ends the query in FAILFAST, goes in
    DROPMALFORMED, and stays in PERMISSIVE, whole as text in `_corrupt_record`. Without line breaks in fields, large files
    are split.
    """
    options = {"sep": delimiter, "header": header, "multiLine": line_breaks, "quote": '"', "escape": '"', "mode": mode, "enforceSchema": True, "columnPruning": False}
    reader = spark.read.options(**options)
    if schema is None:
        schema = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in reader.option("mode", "PERMISSIVE").csv(path).schema)
    full = f"{schema}, `{CORRUPT}` string" if mode == "PERMISSIVE" else schema
    rows = reader.options(mode=mode, columnNameOfCorruptRecord=CORRUPT).schema(full).csv(path)
    return rows.select(*[F.coalesce(f"`{c}`", F.lit("")).alias(c) if t == "string" and c != CORRUPT else F.col(f"`{c}`") for c, t in rows.dtypes])
