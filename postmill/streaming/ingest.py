"""Structured Streaming forms: incremental ingest, stream deduplication, hourly counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postmill.functions.text import signature
from postmill.operators.dedup import dedup_run
from postmill.operators.stats import RunMetrics
from postmill.schemas import RUNS
from postmill.sources.store import PostingStore, refusal


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder where every executor can write: under `spark.checkpoint.dir`. A temporary
    folder only stands in for it in a single-JVM session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="postmill-")
    return f"{base.rstrip('/')}/postmill-{uuid.uuid4().hex}"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The lasting id of the query a checkpoint belongs to; a new checkpoint is a new stream."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def batch_name(stream: str, batch_id: int) -> str:
    """The name of a stream's micro-batch in the store; names sort as the batches ran."""
    return f"{stream}-{batch_id:09d}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write a frame, in place of an earlier try, and read it back: what follows uses it several times."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def instant(spark: SparkSession, now: Column) -> int:
    """An instant as microseconds, evaluated once: all rows of a run carry the same one."""
    return spark.range(1).select(F.unix_micros(now.cast("timestamp")).alias("t")).first()["t"]


def _window_start(spark: SparkSession, runs_path: str, stream: str, batch_id: int, at: int) -> int:
    """Where the stream's last window ended, so that windows meet; its own instant for the first one."""
    if batch_id == 0:
        return at
    path = f"{runs_path}/run={batch_name(stream, batch_id - 1)}"
    row = spark.read.schema(RUNS).parquet(path).select(F.unix_micros("until").alias("t")).first()
    return min(row["t"], at) if row else at


def note_run(spark: SparkSession, runs_path: str, stream: str, batch_id: int, at: int, counts: dict[str, int]) -> None:
    """the run's window and counters, at a path of its own that a retry replaces.

    The window is half open and ends a microsecond after the instant its rows carry as
    `created_at`; it starts where the stream's last window ended.
    """
    since = _window_start(spark, runs_path, stream, batch_id, at)
    known = {"run_id": F.lit(str(batch_id)), "since": F.timestamp_micros(F.lit(since)), "until": F.timestamp_micros(F.lit(at + 1))}
    known |= {"stream": F.lit(stream), **{name: F.lit(n) for name, n in counts.items()}}
    row = spark.range(1).select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RUNS.fields])
    row.coalesce(1).write.mode("overwrite").parquet(f"{runs_path}/run={batch_name(stream, batch_id)}")


def ingest_batch(
    store: PostingStore, runs_path: str, now: Callable[[], Column], stream: Callable[[], str]
) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` body - deduplicate, append, note the run.

    A micro-batch is a run. It is staged first, so its source is read once. A replayed batch writes the
    same partition of the store and the same run again; it is judged without its own earlier rows.
    The counters are observed while the rows are written.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, batch_name(stream(), batch_id)
        at = instant(spark, now())
        incoming = staged(batch, f"{runs_path}-incoming/{name}")
        metrics = RunMetrics(())
        judged = metrics.watch(dedup_run(incoming, store.urls(without=name)), refusal())
        saved = judged.filter(F.col("status") == "saved").drop("status", "reason")
        store.append(saved, F.timestamp_micros(F.lit(at)), name)
        note_run(spark, runs_path, stream(), batch_id, at, metrics.totals())

    return save


def drain(stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """F2: hand what has arrived to `save` in micro-batches (`availableNow`), then stop. The clock that starts
    the next increment is outside."""
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(
    postings: DataFrame, store_root: str, checkpoint: str, now: Callable[[], Column] = F.current_timestamp
) -> StreamingQuery:
    """finished postings into the store."""
    spark = postings.sparkSession
    name = cache(lambda: stream_id(spark, checkpoint))
    save = ingest_batch(PostingStore(spark, f"{store_root}/star"), f"{store_root}/runs", now, name)
    return drain(postings, save, checkpoint)


def read_runs(spark: SparkSession, store_root: str) -> DataFrame:
    """run windows noted by the ingest, for `operators.search.in_window`."""
    return spark.read.schema(RUNS).parquet(f"{store_root}/runs/run=*")


def stream_first_rows(
    postings: DataFrame,
    known: DataFrame,
    time: str = "extracted_at",
    hold: str = "1 hour",
    order: str = "arrival",
    unicode: bool = False,
) -> DataFrame:
    """the whole first row of each signature, of urls that are not `known`.

    Of a micro-batch the row with the lowest `order` counts; a signature then blocks later rows for `hold`
    after the time of that row, when the watermark lets it go. Rows behind the watermark are dropped. The
    state of a signature is its expiry alone, and its rows are looked at one chunk at a time.
    """
    keyed = postings.withColumn("signature", signature(F.col("title"), F.col("company"), unicode))
    fresh = keyed.withWatermark(time, hold).join(known.select("url").distinct(), "url", "left_anti")
    held = round(pd.Timedelta(hold).total_seconds() * 1000)

    def first(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for chunk in chunks:
            head = chunk.nsmallest(1, order)
            if best is None or head[order].iloc[0] < best[order].iloc[0]:
                best = head
        if best is not None and not state.exists:
            until = int(best[time].iloc[0].timestamp() * 1000) + held
            state.update((until,))
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
            yield best

    grouped = fresh.groupBy("signature")
    return grouped.applyInPandasWithState(first, fresh.schema, "until long", "append", GroupStateTimeout.EventTimeTimeout)


def drop_late(postings: DataFrame, max_age_days: int, now: Column | None = None) -> DataFrame:
    """postings older than the limit."""
    at = F.current_timestamp() if now is None else now
    return postings.filter(F.unix_micros("posted_at") >= F.unix_micros(at) - max_age_days * 86_400_000_000)


def counts_by_window(df: DataFrame, time: str, key: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """rows per tumbling window and key; works on streams (append mode) and tables."""
    return (
        df.withWatermark(time, delay)
        .groupBy(F.window(time, width), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), key, "n")
    )


def drain_to_table(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Run a stream over everything available and return what it appended, as a table."""
    out = f"{folder}/{name}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{folder}/{name}-checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
