"""Entity deduplication.

"First in its group" is a minimum of the arrival number, so groups are combined on the
map side and a group that holds a third of all rows still costs one partial result per
task. Rows meet their verdict through the arrival number, which is unique and therefore
spreads evenly, and only narrow key columns are shuffled for the decision.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import signature


def first_per_key(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """Keys with the lowest value of `order`, one row per key."""
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def dedup_urls(df: DataFrame, url: str = "url", order: str = "arrival") -> DataFrame:
    """First row of each url; `order` must be unique."""
    firsts = first_per_key(df.select(url, order), url, order).select(order)
    return df.join(firsts, order, "left_semi")


def new_urls(df: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose url is not known yet."""
    return df.join(seen.select(url).distinct(), url, "left_anti")


def known_urls(df: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose url is known."""
    return df.join(seen.select(url).distinct(), url, "left_semi")


def new_pages(
    pages: DataFrame,
    known: DataFrame,
    url: str = "url",
    order: str = "page_id",
    watch: Callable[[DataFrame], DataFrame] = lambda names: names,
) -> DataFrame:
    """W2/J3 before extraction: the first page of each url, of urls that are not known.

    Decided on (url, order) alone, so pages that go are never parsed. `order` must be unique. `watch` may
    observe all (url, order) on their way.
    """
    firsts = first_per_key(watch(pages.select(url, order)), url, order)
    fresh = firsts.join(known.select(F.col("url").alias(url)), url, "left_anti").select(order)
    return pages.join(fresh, order, "left_semi")


def dedup_run(
    postings: DataFrame,
    stored_urls: DataFrame,
    order: str = "arrival",
    unicode: bool = False,
    key: Column | None = None,
) -> DataFrame:
    """`status` and `reason` of every posting of a run.

    In arrival order a posting is saved iff it is the first with its signature in the run,
    its url is not stored, and it is the first such survivor for its url. The first of a
    signature blocks the rest even when its own url was already stored.
    `reason` says whether a duplicate fell to its signature or its url.
    `stored_urls` has a column `url`; `order` must be unique; `key` is another identity than the signature.
    """
    identity = signature(F.col("title"), F.col("company"), unicode) if key is None else key
    # First of each signature with its url, then first of each url among those: both keep one partial
    # row per key and task, so hot signatures and urls cost nothing extra.
    first = F.min(F.struct(order, "url")).alias("_first")
    heads = postings.select(order, "url", identity.alias("_key")).groupBy("_key").agg(first).select("_first.*")
    saved = first_per_key(heads, "url", order).join(stored_urls.select("url"), "url", "left_anti")
    marks = (
        heads.select(order, F.lit(1).alias("_mark"))
        .unionByName(saved.select(order, F.lit(2).alias("_mark")))
        .groupBy(order)
        .agg(F.max("_mark").alias("_mark"))
    )
    reason = F.when(F.col("_mark").isNull(), "signature").when(F.col("_mark") == 1, "url")
    return (
        postings.join(marks, order, "left")
        .withColumn("reason", reason)
        .withColumn("status", F.when(F.col("_mark") == 2, "saved").otherwise("duplicate"))
        .drop("_mark")
    )


def append_sources(*frames: DataFrame) -> DataFrame:
    """Rows of all sources in one table, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """U1 on rows."""
    return append_sources(*frames).distinct()


def array_new_only(values: Column, seen: Column) -> Column:
    """U2 on arrays."""
    return F.array_except(values, seen)
