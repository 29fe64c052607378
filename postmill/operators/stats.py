"""Counts (A1-A6)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postmill.operators.common import explode_once

# Boards whose run only counts as a success when it found something.
NEEDS_RESULTS = ("Wuzzuf", "Indeed", "Glassdoor")


def count_all(df: DataFrame) -> DataFrame:
    """A1."""
    return df.agg(F.count("*").alias("total"))


def count_by_source(df: DataFrame, source: str = "source") -> DataFrame:
    """A2."""
    return df.groupBy(source).agg(F.count("*").alias("n"))


def stats_map(df: DataFrame, source: str = "source") -> DataFrame:
    """A1 and A2 as one row: total and a map of counts. Only the counts reach the last step."""
    pairs = F.sort_array(F.collect_list(F.struct(source, "n")))
    return count_by_source(df, source).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(pairs).alias("by_source")
    )


def skill_counts(df: DataFrame, *keys: str) -> DataFrame:
    """A4/A2 on exploded skills: postings per skill (and further keys)."""
    return explode_once(df, [*keys], F.col("skills"), "skill").groupBy(*keys, "skill").agg(F.count("*").alias("n"))


def run_success(source: Column, found: Column, failed: Column) -> Column:
    """No failure, and for some boards at least one result."""
    return F.when(source.isin(*NEEDS_RESULTS), found > 0).otherwise(~failed)


def run_counters(df: DataFrame, sources: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """Per source fetched, saved and duplicates of a `dedup_run` result, and the run's success.

    `sources` (source) lists the boards of the run, so that one without a row is reported with
    zeros; `failed` (source) lists those whose fetching ended in an error.
    """
    counts = ("fetched", "saved", "duplicates")
    counted = df.groupBy("source").agg(
        F.count("*").alias("fetched"),
        F.count_if(F.col("status") == "saved").alias("saved"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
    )
    if sources is not None:
        counted = sources.select("source").distinct().join(counted, "source", "left").na.fill(0, list(counts))
    if failed is None:
        return counted.withColumn("success", run_success(F.col("source"), F.col("fetched"), F.lit(False)))
    marked = counted.join(failed.select("source").distinct().withColumn("_failed", F.lit(True)), "source", "left")
    error = F.coalesce("_failed", F.lit(False))
    return marked.withColumn("success", run_success(F.col("source"), F.col("fetched"), error)).drop("_failed")


def run_totals(df: DataFrame) -> DataFrame:
    """A5: the same over the whole run."""
    return df.agg(
        F.count("*").alias("fetched"),
        F.count_if(F.col("status") == "saved").alias("saved"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
    )


COUNTERS = ("fetched", "saved", "duplicates", "rejected")


class RunMetrics:
    """The counters of a run, observed while its rows are written, without a job of their own.

    `watch` goes around a `dedup_run` result that one action then consumes; the counters are there when
    that action ends. `refused` says why the store does not take a row (null: it does). Boards that are
    not named count in the totals alone.
    """

    def __init__(self, boards: Iterable[str]):
        self.boards = tuple(boards)
        self.observation = Observation()

    def watch(self, judged: DataFrame, refused: Column | None = None) -> DataFrame:
        saved = F.col("status") == "saved"
        bad = saved & (F.lit(False) if refused is None else refused.isNotNull())
        kinds = dict(zip(COUNTERS, (F.lit(True), saved & ~bad, F.col("status") == "duplicate", bad), strict=True))
        counts = [F.count_if(test).alias(name) for name, test in kinds.items()]
        for k, board in enumerate(self.boards):
            here = F.col("source") == board
            counts += [F.count_if(here & test).alias(f"{name}_{k}") for name, test in kinds.items()]
        return judged.observe(self.observation, *counts)

    def totals(self) -> dict[str, int]:
        return {name: self.observation.get[name] for name in COUNTERS}

    def by_source(self, spark: SparkSession, failed: Iterable[str] = ()) -> DataFrame:
        """As `run_counters`, with the rejected rows; silent boards are there with zeros."""
        seen = self.observation.get
        rows = [(b, *[seen[f"{name}_{k}"] for name in COUNTERS], b in set(failed)) for k, b in enumerate(self.boards)]
        columns = ", ".join(f"{name} long" for name in COUNTERS)
        counted = spark.createDataFrame(rows, f"source string, {columns}, _failed boolean")
        success = run_success(F.col("source"), F.col("fetched"), F.col("_failed"))
        return counted.withColumn("success", success).drop("_failed")
