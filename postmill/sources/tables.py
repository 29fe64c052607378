"""Reading Parquet tables the way the operators expect them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _zoned(df: DataFrame) -> DataFrame:
    """Zone-less instants as UTC instants (watermarks and age arithmetic need those)."""
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return _zoned(spark.read.parquet(path))
