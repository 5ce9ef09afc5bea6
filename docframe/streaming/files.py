"""Conversion of files as they arrive. Each file stands for itself, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.convert import Options, convert_column


def arriving(spark: SparkSession, folder: str, source: str, target: str, options: Options = Options()) -> DataFrame:
    """A stream of (path, converted, error) for files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return convert_column(files.select("path", "content"), "content", source, target, options).select("path", "converted", "error")


def write(stream: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes a stream as Parquet; a restart goes on from the checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
