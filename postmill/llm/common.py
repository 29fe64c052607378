"""What the operators share: reading, staging on the shared folder, text chunks inside tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one task handles at a time (a longer single text is a chunk of its own).
CHUNK_BYTES = 1 << 20

#: Bytes of an Arrow batch on its way to Python, and Spark's setting for it.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: The white space of the word rule: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"

#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`; a temporary one only in a single-JVM session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="postmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str, name: str, **options: object) -> DataFrame:
    """Write a frame under the shared folder and read it back: it runs once and its lineage ends."""
    path = f"{folder}/{name}"
    df.write.options(**options).option("compression", "zstd").mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def limit_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session go to Python at `BATCH_BYTES` at most.

    For frames that their caller executes, after the operator has returned. Results do not depend on it.
    """
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Arrow batches go to Python at `BATCH_BYTES` at most (a larger single row alone)."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def text_chunks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of at most `limit` bytes of text and at least one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first = taken = 0
        for i, size in enumerate(sizes):
            if taken and taken + size > limit:
                yield batch.slice(first, i - first)
                first, taken = i, 0
            taken += size
        if first < len(sizes):
            yield batch.slice(first)
    pa.default_memory_pool().release_unused()  # the worker stays and serves other tasks


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts as strings; null is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
