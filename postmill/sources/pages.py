"""Stored crawl output (S1): (page_id, url, html) rows, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.schemas import PAGE


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Pages from Parquet or JSON tables, or from one HTML file per page (`format="html"`)."""
    if format == "html":
        files = spark.read.text(path, wholetext=True)
        return files.select(
            F.xxhash64("_metadata.file_path").alias("page_id"),
            F.col("_metadata.file_path").alias("url"),
            F.col("value").alias("html"),
        )
    return spark.read.schema(PAGE).format(format).load(path)


def stream_pages(spark: SparkSession, path: str, format: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream over arriving files."""
    return (
        spark.readStream.schema(PAGE).format(format).option("maxFilesPerTrigger", files_per_batch).load(path)
    )
