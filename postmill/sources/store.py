"""The keyed store of postings, skills and links.

On disk the store is one Parquet table of posting rows, partitioned by batch. A batch writes its own
partition, whatever the size of the store, and replaces it when it is run again; the three tables are
queries over the rows: the first row of a url gives id, source and creation time, the last one the rest.
On a table format with `MERGE INTO` the same staged frames can feed one instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import schemas
from postmill.functions.jobtype import job_type_from_store, job_type_to_store
from postmill.functions.text import trim_all

TABLES = {
    "postings": schemas.STORE_POSTINGS,
    "skills": schemas.STORE_SKILLS,
    "links": schemas.STORE_LINKS,
}


@dataclass(frozen=True)
class Star:
    """The three tables of the store."""

    postings: DataFrame
    skills: DataFrame
    links: DataFrame


def empty_star(spark: SparkSession) -> Star:
    return Star(*[spark.createDataFrame([], schema) for schema in TABLES.values()])


def validate(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows the store takes, and the rest."""
    ok = F.col("url").isNotNull() & (F.col("url") != "") & F.col("title").isNotNull() & (F.col("title") != "")
    return postings.filter(ok), postings.filter(~F.coalesce(ok, F.lit(False)))


def _surrogate(key: Column) -> Column:
    """Replayable id: the same natural key gives the same id in every attempt of a task."""
    return F.md5(key)


def stage_postings(postings: DataFrame, order: str = "arrival") -> DataFrame:
    """One row per url of a batch: the last row's fields, the first row's source.

    First and last are minima and maxima of the arrival number, combined on the map side;
    the wide rows are then picked by that unique number.
    """
    ends = postings.groupBy("url").agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    firsts = postings.select(F.col(order).alias("_first"), F.col("source").alias("_source"))
    last_of = ends.join(firsts, "_first").select(F.col("_last").alias(order), "_source")
    return postings.join(last_of, order).select(
        _surrogate(F.col("url")).alias("posting_id"),
        "url",
        F.col("_source").alias("source"),
        "title",
        F.col("company").alias("company_name"),
        "location",
        "description",
        "salary",
        job_type_to_store(F.col("job_type")).alias("job_type"),
        "posted_at",
    )


def stage_links(postings: DataFrame) -> DataFrame:
    """Distinct (posting_id, name) of a batch; skill names are trimmed, empty ones skipped."""
    return (
        postings.select(_surrogate(F.col("url")).alias("posting_id"), F.explode("skills").alias("_raw"))
        .select("posting_id", trim_all(F.col("_raw")).alias("name"))
        .filter(F.col("name") != "")
        .distinct()
    )


def upsert_postings(target: DataFrame, staged: DataFrame, now: Column) -> DataFrame:
    """Insert, or on a known url update all but id, source and creation time."""
    t, s = target.alias("t"), staged.alias("s")
    new = F.col("s.url").isNotNull()
    keep = lambda c: F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c)
    take = lambda c: F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return t.join(s, F.col("t.url") == F.col("s.url"), "full_outer").select(
        keep("posting_id"),
        keep("url"),
        keep("source"),
        *[take(c) for c in ("title", "company_name", "location", "description", "salary", "job_type", "posted_at")],
        F.coalesce("t.created_at", now).alias("created_at"),
        F.when(new, now).otherwise(F.col("t.updated_at")).alias("updated_at"),
    )


def upsert_skills(target: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """Insert, or touch `updated_at` of a known name."""
    t, s = target.alias("t"), names.select("name").distinct().alias("s")
    return t.join(s, F.col("t.name") == F.col("s.name"), "full_outer").select(
        F.coalesce("t.skill_id", _surrogate(F.col("s.name"))).alias("skill_id"),
        F.coalesce("t.name", "s.name").alias("name"),
        F.coalesce("t.created_at", now).alias("created_at"),
        F.when(F.col("s.name").isNotNull(), now).otherwise(F.col("t.updated_at")).alias("updated_at"),
    )


def upsert_links(target: DataFrame, staged: DataFrame, now: Column) -> DataFrame:
    """Link when absent; links are never removed."""
    fresh = staged.select("posting_id", _surrogate(F.col("name")).alias("skill_id")).join(
        target, ["posting_id", "skill_id"], "left_anti"
    )
    return target.unionByName(fresh.withColumn("created_at", now))


def upsert_star(store: Star, postings: DataFrame, now: Column, order: str = "arrival") -> Star:
    """The store after a batch of postings. Applying a batch twice changes only `updated_at`."""
    good, _ = validate(postings)
    links = stage_links(good)
    return Star(
        upsert_postings(store.postings, stage_postings(good, order), now),
        upsert_skills(store.skills, links, now),
        upsert_links(store.links, links, now),
    )


def assemble(store: Star, now: Column) -> DataFrame:
    """Postings with their skill names, defaults filled in.

    Names are sorted: the link table keeps no order. Links are grouped before they meet the
    wide posting rows.
    """
    names = (
        store.links.join(store.skills.select("skill_id", "name"), "skill_id")
        .groupBy("posting_id")
        .agg(F.sort_array(F.collect_list("name")).alias("skills"))
    )
    p = store.postings.join(names, "posting_id", "left")
    return p.select(
        "posting_id",
        "title",
        F.col("company_name").alias("company"),
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("description", F.lit("")).alias("description"),
        "url",
        "salary",
        F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
        job_type_from_store(F.col("job_type")).alias("job_type"),
        "source",
        F.coalesce("posted_at", now).alias("posted_at"),
        F.coalesce("updated_at", now).alias("extracted_at"),
        "created_at",
    )


def search_star(store: Star, skills: list[str], now: Column, limit: int = 100) -> DataFrame:
    """J2/P1 on the store: decide the newest matching postings on keys, then assemble only those."""
    hits = store.skills.filter(_any_ilike(skills))
    matching = store.links.join(hits.select("skill_id"), "skill_id", "left_semi").select("posting_id")
    newest = (
        store.postings.select("posting_id", "posted_at")
        .join(matching, "posting_id", "left_semi")
        .orderBy(F.col("posted_at").desc_nulls_first(), "posting_id")
        .limit(limit)
        .select("posting_id")
    )
    chosen = Star(
        store.postings.join(newest, "posting_id", "left_semi"),
        hits,
        store.links.join(newest, "posting_id", "left_semi"),
    )
    return assemble(chosen, now).orderBy(F.col("posted_at").desc_nulls_first(), "posting_id")


def _any_ilike(skills: list[str]) -> Column:
    out = F.lit(False)
    for text in skills:
        out = out | F.col("name").ilike(f"%{text}%")
    return out


def upsert_source_registry(target: DataFrame, staged: DataFrame) -> DataFrame:
    """Keyed replace on `name`."""
    kept = target.join(staged.select("name"), "name", "left_anti").select(*target.columns)
    return kept.unionByName(staged.select(*target.columns))


def registry_rows(postings: DataFrame, base_urls: dict[str, str]) -> DataFrame:
    """Registry rows of a run: postings per source and the time of the last one."""
    url = F.coalesce(*[F.when(F.col("source") == name, url) for name, url in base_urls.items()])
    return postings.groupBy("source").agg(
        F.max("extracted_at").alias("last_fetched"), F.count("*").alias("total")
    ).select(
        F.col("source").alias("name"), url.alias("url"), F.lit(True).alias("is_active"), "last_fetched", "total"
    )


def star_of(rows: DataFrame) -> Star:
    """The star of posting rows in any number of batches (`schemas.BATCH_ROW`).

    Rows of a url are ordered by (instant, batch, arrival). Its last fields and first identity are a
    maximum and a minimum, combined on the map side, so a url costs a row per task however often it comes.
    """
    order = F.struct("at", "batch", "arrival")
    last = F.struct("title", "company", "location", "description", "salary", "job_type", "posted_at")
    grouped = rows.groupBy("url").agg(
        F.min_by("source", order).alias("source"),
        F.max_by(last, order).alias("last"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
    )
    shown = grouped.select("url", "source", "last.*", "created_at", "updated_at")
    stored = {"posting_id": _surrogate(F.col("url")), "job_type": job_type_to_store(F.col("job_type"))}
    postings = shown.withColumns(stored).withColumnRenamed("company", "company_name").select(*TABLES["postings"].names)
    named = rows.select("url", "at", F.explode("skills").alias("name")).withColumn("name", trim_all(F.col("name"))).filter("name <> ''")
    linked = named.groupBy("url", "name").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    skills = linked.groupBy("name").agg(F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    ids = {"posting_id": _surrogate(F.col("url")), "skill_id": _surrogate(F.col("name"))}
    return Star(
        postings,
        skills.withColumn("skill_id", ids["skill_id"]).select(*TABLES["skills"].names),
        linked.withColumns(ids).select(*TABLES["links"].names),
    )


def refusal() -> Column:
    """Why the store does not take a row; null for a row it takes."""
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return F.when(missing("url"), "no url").when(missing("title"), "no title")


class PostingStore:
    """Posting rows under one shared folder (any Hadoop file system), a partition per batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/postings"

    def append(self, postings: DataFrame, at: Column, batch: str) -> None:
        """Write a batch, in place of an earlier try of it. Refused rows are kept with their reason."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("batches are named by letters, digits, dots, dashes and underscores")
        rows = postings.withColumns({"at": at.cast("timestamp"), "reason": refusal()})
        fields = [f for f in schemas.BATCH_ROW.fields if f.name != "batch"]
        given = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        rows.select(*given).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def rows(self, without: str | None = None) -> DataFrame:
        """All rows, or those of the other batches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schemas.BATCH_ROW)
        found = self.spark.read.schema(schemas.BATCH_ROW).parquet(self.path)
        return found if without is None else found.filter(F.col("batch") != without)

    def read(self) -> Star:
        """The state after all batches."""
        return star_of(self.rows().filter("reason IS NULL"))

    def urls(self, without: str | None = None) -> DataFrame:
        """The known urls: one narrow column is read."""
        return self.rows(without).filter("reason IS NULL").select("url")

    def rejected(self) -> DataFrame:
        """The rows that batches brought and the store did not take."""
        return self.rows().filter("reason IS NOT NULL").withColumnRenamed("at", "rejected_at").select(*schemas.REJECTED.names)
