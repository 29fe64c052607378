"""The flat posting store and answer envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.schemas import FLAT_ROW, POSTING

_INSTANTS = ("posted_at", "extracted_at")


def to_flat(postings: DataFrame, created_at: Column) -> DataFrame:
    """Postings as flat rows: skills as JSON text, instants as ISO text."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    flat = postings.withColumns({"skills": F.to_json("skills"), **{c: iso(c) for c in _INSTANTS}})
    return flat.withColumn("created_at", created_at)


def from_flat(rows: DataFrame) -> DataFrame:
    """Flat rows as postings; missing skill text is an empty list."""
    skills = F.from_json(F.coalesce("skills", F.lit("[]")), "array<string>")
    parsed = rows.withColumns({"skills": skills, **{c: F.col(c).try_cast("timestamp") for c in _INSTANTS}})
    return parsed.select(*POSTING.names)


def read_flat(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return from_flat(spark.read.schema(FLAT_ROW).format(format).load(path))


def replace_flat(stored: DataFrame, arrivals: DataFrame, order: str = "arrival") -> DataFrame:
    """Insert-or-replace on two keys, `posting_id` and `url`.

    Rows are taken in `order`; a row deletes every earlier one that has its id or its url.
    `stored` has the columns of `arrivals` without `order`, and unique ids and urls. An
    earlier arrival survives iff it is the last of both its id and its url; a stored row
    iff no arrival at all has either. Each "last" is a map-side combined maximum.
    """
    keys = arrivals.select(order, "posting_id", "url")
    last_by_id = keys.groupBy("posting_id").agg(F.max(order).alias(order)).select(order)
    last_by_url = keys.groupBy("url").agg(F.max(order).alias(order)).select(order)
    survivors = last_by_id.join(last_by_url, order, "left_semi")
    kept_new = arrivals.join(survivors, order, "left_semi").drop(order)
    kept_old = stored.join(keys.select("posting_id").distinct(), "posting_id", "left_anti").join(
        keys.select("url").distinct(), "url", "left_anti"
    )
    return kept_old.select(*kept_new.columns).unionByName(kept_new)


def result_envelope(df: DataFrame, limit: int, name: str = "jobs") -> DataFrame:
    """{success, count, <name>} as one JSON text, for answers of at most `limit` rows.

    A longer answer is refused with an error rather than cut; no more than `limit` + 1 rows are gathered.
    """
    rows = df.limit(limit + 1).agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
    body = F.to_json(
        F.struct(F.lit(True).alias("success"), F.size("rows").alias("count"), F.col("rows").alias(name))
    )
    refused = F.raise_error(F.lit(f"the answer has more than {limit} rows")).cast("string")
    return rows.select(F.when(F.size("rows") <= limit, body).otherwise(refused).alias("body"))
