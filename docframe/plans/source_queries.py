"""Queries that write tables to files of the formats and read them back through Spark's data sources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables as T
from ..sources import delimited, stores, workbooks
from .queries import _read, query


def _saved(df: DataFrame, **options: object) -> str:
    """The folder that holds df as workbooks."""
    workbooks.register(df.sparkSession)
    folder = stores.scratch(df.sparkSession)
    df.write.format("workbook").options(**options).mode("append").save(folder)
    return folder


@query("workbook_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def workbook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as workbooks, read in ranges of rows."""
    orders = _read(spark, sf_dir, "orders").drop("o_orderdate")
    folder = _saved(orders, rowsPerFile=20_000)
    return spark.read.format("workbook").option("rowsPerPartition", 5_000).load(folder)


@query("workbook_scan_filtered", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey IN (3, 5, 8) AND c_acctbal >= 0")
def workbook_scan_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sheets of the other family, rows chosen as they are read."""
    folder = _saved(_read(spark, sf_dir, "customer"), kind="ods", sheet="Customers")
    conditions = json.dumps([["c_nationkey", "in", [3, 5, 8]], ["c_acctbal", ">=", 0], ["_sheet", "=", "Customers"]])
    rows = spark.read.format("workbook").option("metadata", "true").option("filters", conditions).load(folder)
    return rows.select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query("workbook_scan_broken", "SELECT event_id, try_cast(value AS BIGINT) IS NOT NULL AND value = floor(value) AS whole FROM events WHERE value IS NOT NULL")
def workbook_scan_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose values are read as whole numbers: those that are none are broken records, and kept."""
    events = _read(spark, sf_dir, "events").where("value is not null").select("event_id", "value")
    folder = _saved(events)
    rows = spark.read.format("workbook").option("mode", "PERMISSIVE").schema("event_id long, value long, _corrupt_record string").load(folder)
    return rows.select("event_id", F.col("_corrupt_record").isNull().alias("whole"))


@query("csv_scan", "SELECT conv_id, turn, role || chr(10) || ';' || chr(34) AS role, text FROM conversations")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as delimited text, with line breaks, quotes and delimiters inside fields."""
    role = F.concat("role", F.lit('\n;"')).alias("role")
    folder = _saved(_read(spark, sf_dir, "conversations").select("conv_id", "turn", role, "text"), kind="csv")
    return delimited.read(spark, f"{folder}/*.csv", schema="conv_id long, turn long, role string, text string")


@query(
    "csv_scan_broken",
    """SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey || ';' || o_custkey || ';more'
      WHEN o_orderkey % 7 = 0 THEN o_orderkey::VARCHAR END AS broken FROM orders""",
)
def csv_scan_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines, some with a field too many or too few, which are kept whole."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    line = F.when(F.col("o_orderkey") % 5 == 0, F.concat_ws(";", key, cust, F.lit("more"))).when(F.col("o_orderkey") % 7 == 0, key).otherwise(F.concat_ws(";", key, cust))
    folder = stores.scratch(spark)
    _read(spark, sf_dir, "orders").select(line.alias("line")).write.text(folder)
    rows = delimited.read(spark, folder, ";", "id string, cust string", "PERMISSIVE", header=False, line_breaks=False)
    return rows.select("id", F.col(delimited.CORRUPT).alias("broken"))


@query("documents_saved", "SELECT conv_id || '.txt' AS name, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS checksum FROM conversations GROUP BY conv_id")
def documents_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each conversation, all written at once, and what is in them."""
    line = F.concat("role", F.lit(": "), "text")
    texts = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(T.ordered_lines(line, ["turn"]).alias("content"))
    workbooks.register(spark)
    folder = stores.scratch(spark)
    texts.select(F.concat(F.col("conv_id").cast("string"), F.lit(".txt")).alias("name"), "content").write.format("document_files").mode("append").save(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("checksum"))
