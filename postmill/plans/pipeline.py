"""Pages to store in one plan, as a batch or as a stream (F1)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.functions.text import signature
from postmill.functions.urls import BASE_URLS
from postmill.functions.vocabulary import ROLE_SKILLS, RoleSkills
from postmill.operators.dedup import dedup_run, new_pages
from postmill.operators.enrich import cleaned, fresh_only, make_postings
from postmill.operators.pages import detail_to_raw
from postmill.operators.stats import RunMetrics
from postmill.sources.store import PostingStore, refusal
from postmill.streaming import ingest


@dataclass(frozen=True)
class PipelineOptions:
    """`uniform` enhances the skills of every board; `unicode` keeps other scripts in signatures."""

    uniform: bool = False
    unicode: bool = False
    role_skills: RoleSkills = None  # type: ignore[assignment]

    def dictionary(self) -> RoleSkills:
        return ROLE_SKILLS if self.role_skills is None else self.role_skills


def pages_to_postings(pages: DataFrame, as_of: Column, options: PipelineOptions = PipelineOptions()) -> DataFrame:
    """Extraction, enrichment and freshness; `pages` carries a `source` column."""
    raw = detail_to_raw(pages, as_of)
    return make_postings(fresh_only(raw, as_of), as_of, options.uniform, options.dictionary())


def judge(raw: DataFrame, stored_urls: DataFrame, options: PipelineOptions = PipelineOptions()) -> DataFrame:
    """W1 on extracted rows, before their texts are tagged: rows with `status` and `reason`."""
    return dedup_run(raw, stored_urls, key=signature(cleaned("title"), cleaned("company"), options.unicode))


@dataclass(frozen=True)
class Run:
    """What a run did: its judged rows, its counters, and how many pages came and were extracted."""

    judged: DataFrame
    metrics: RunMetrics
    pages: Observation
    extracted: Observation

    def counts(self) -> dict[str, int]:
        return {**self.metrics.totals(), "pages": self.pages.get["n"], "extracted": self.extracted.get["n"]}


def run(pages: DataFrame, store: PostingStore, now: Column, batch: str, options: PipelineOptions = PipelineOptions()) -> Run:
    """One run: the pages of new urls become a batch of the store.

    Repeated and known urls go first, on (url, page_id) alone; the rest is parsed once and staged; W1 is
    decided on the staged rows; only rows that are saved are tagged. A run of the same name replaces its rows.
    """
    known = store.urls(without=batch)
    came, parsed = Observation(), Observation()
    count = F.count("*").alias("n")
    new = new_pages(pages, known, watch=lambda names: names.observe(came, count)).observe(parsed, count)
    raw = ingest.staged(fresh_only(detail_to_raw(new, now), now), f"{store.path}-incoming/{batch}")
    judged = judge(raw, known, options)
    metrics = RunMetrics(BASE_URLS)
    saved = metrics.watch(judged, refusal()).filter(F.col("status") == "saved").drop("status", "reason")
    store.append(make_postings(saved, now, options.uniform, options.dictionary()), now, batch)
    return Run(judged, metrics, came, parsed)


def stream_pages_to_store(
    pages: DataFrame,
    store_root: str,
    checkpoint: str,
    now: Callable[[], Column] = F.current_timestamp,
    options: PipelineOptions = PipelineOptions(),
) -> StreamingQuery:
    """Arriving pages into the store; each micro-batch is a `run` and notes its window and counters.

    Only pages of new urls reach the extractor: the stream is joined against the store's urls before it.
    """
    spark = pages.sparkSession
    store, runs = PostingStore(spark, f"{store_root}/star"), f"{store_root}/runs"
    stream = cache(lambda: ingest.stream_id(spark, checkpoint))

    def save(batch: DataFrame, batch_id: int) -> None:
        at = ingest.instant(spark, now())
        done = run(batch, store, F.timestamp_micros(F.lit(at)), ingest.batch_name(stream(), batch_id), options)
        ingest.note_run(spark, runs, stream(), batch_id, at, done.counts())

    return ingest.drain(pages, save, checkpoint)
