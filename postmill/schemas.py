"""Row shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

# What an extraction step hands to `operators.enrich.make_postings`.
RAW_POSTING = T.StructType(
    [
        T.StructField("arrival", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("salary", T.StringType()),
        T.StructField("posted_at", T.TimestampType()),
    ]
)

POSTING = T.StructType(
    [
        T.StructField("posting_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("salary", T.StringType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("job_type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("posted_at", T.TimestampType()),
        T.StructField("extracted_at", T.TimestampType()),
    ]
)

# The flat store keeps skills as JSON text and instants as ISO text.
FLAT_ROW = T.StructType(
    [
        T.StructField(f.name, T.StringType())
        for f in POSTING.fields
    ]
    + [T.StructField("created_at", T.TimestampType())]
)

STORE_POSTINGS = T.StructType(
    [
        T.StructField("posting_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("salary", T.StringType()),
        T.StructField("job_type", T.StringType()),
        T.StructField("posted_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

STORE_SKILLS = T.StructType(
    [
        T.StructField("skill_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

STORE_LINKS = T.StructType(
    [
        T.StructField("posting_id", T.StringType()),
        T.StructField("skill_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

SOURCE_REGISTRY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("last_fetched", T.TimestampType()),
        T.StructField("total", T.LongType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("since", T.TimestampType()),
        T.StructField("until", T.TimestampType()),
        T.StructField("fetched", T.LongType()),
        T.StructField("saved", T.LongType()),
        T.StructField("duplicates", T.LongType()),
        T.StructField("rejected", T.LongType()),
        T.StructField("stream", T.StringType()),
        T.StructField("pages", T.LongType()),
        T.StructField("extracted", T.LongType()),
    ]
)

# A posting as a batch brought it; `reason` says why the store did not take it.
BATCH_ROW = T.StructType(
    [
        *RAW_POSTING.fields,
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("job_type", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("batch", T.StringType()),
    ]
)

# Rows the store did not take.
REJECTED = T.StructType([*BATCH_ROW.fields[:-2], T.StructField("rejected_at", T.TimestampType())])
