"""A deterministic posting table over the test tables.

Documents supply the texts; titles, companies, places, urls, dates and salaries are
assigned by arithmetic on the document number, so every rule of the operators fires and
the same table can be written in plain SQL (`plans.oracle`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import dates as D
from postmill.functions import skills as K
from postmill.functions.jobtype import clean_location, job_type
from postmill.functions.text import clean_text, salary_if_numeric
from postmill.functions.urls import posting_id
from postmill.sources.tables import read_table

AS_OF = "2024-03-31 12:00:00"

TITLES = (
    "Junior Frontend Developer",
    "Senior React Frontend Engineer",
    "Full Stack Node.js Developer",
    "Mid-Level DevOps Engineer",
    "QA Automation Engineer",
    "ML Engineer",
    "UI/UX Designer",
    "iOS Developer",
    "Data Scientist",
    "DevOps / Platform Engineer",
    "Site Reliability Engineer",
    "Cloud Engineer",
    "Associate Director",
    "RTOS Firmware Engineer",
    "Software Engineer",
    "Intern, Backend",
    "Engineer (10+ years)",
    "Solutions Architect",
    "Sr. Database Administrator",
    "Game Developer - Unity",
    "Business Analyst",
    "Technical Writer",
    "مهندس برمجيات",
    "Lead Security Engineer (Remote)",
)
TAILS = (
    "Senior React Developer with AWS and Docker experience",
    "Need JS, TS and Postgres; k8s a plus",
    "react native and node.js",
    "C# and C++ and .NET developer",
    "asp.net core",
    "REST API, GraphQL, CI/CD",
    "java script and Java EE",
    "We need rust.",
    "Kafka/Spark on AWS S3",
    "machine learning with pandas",
)
TYPE_TEXTS = (
    "Summer internship",
    "Intern manager",
    "Graduate role, 2 years of experience",
    "Remote contractor",
    "Part time remote",
    "Work from home",
    "International sales",
    "Freelance part-time",
    "Engineer",
)
PHRASES = (
    "3 days ago",
    "5 hours ago",
    "2 weeks ago",
    "45 minutes ago",
    "1 month ago",
    "yesterday",
    "today",
    "Just posted",
    "30+ days ago",
    "14d",
    "30d+",
    "il y a 2 jours",
    "منذ 3 أيام",
    "أمس",
    "2024-03-20",
)
SOURCES = ("LinkedIn", "Indeed", "Glassdoor", "Wuzzuf", "Bayt")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (index % len(values)).cast("int"))


def raw_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Raw postings: one per document."""
    docs = read_table(spark, f"{sf}/documents.parquet")
    pages = read_table(spark, f"{sf}/pages.parquet").select("page_id", "url")
    customers = read_table(spark, f"{sf}/customer.parquet").select("c_custkey", "c_name")
    nations = read_table(spark, f"{sf}/nation.parquet").select("n_nationkey", "n_name")
    n_pages = pages.agg(F.count("*")).scalar()
    n_customers = customers.agg(F.count("*")).scalar()
    d = F.col("doc_id")
    keyed = docs.select(
        d.alias("posting_no"),
        d.alias("arrival"),
        "text",
        F.col("source").alias("feed"),
        ((d * 7) % n_customers).alias("c_custkey"),
        (d % 25).cast("int").alias("n_nationkey"),
        (d % n_pages).alias("page_id"),
    )
    n = F.col("posting_no")
    tenth, fifth = F.floor(n / 3), F.floor(n / 5)
    joined = keyed.join(customers, "c_custkey").join(nations, "n_nationkey").join(pages, "page_id")
    return joined.select(
        "posting_no",
        "arrival",
        "feed",
        _pick(TITLES, n).alias("title"),
        F.col("c_name").alias("company"),
        F.when(n % 7 == 3, F.concat(F.lit("Remote, "), "n_name")).otherwise(F.col("n_name")).alias("location"),
        F.concat_ws(" ", "text", _pick(TAILS, tenth)).alias("description"),
        "url",
        _pick(SOURCES, n).alias("source"),
        _pick(PHRASES, fifth).alias("date_text"),
        F.when(n % 3 == 1, F.lit("Competitive"))
        .when(n % 3 == 2, F.concat(F.lit("$"), (50 + n % 100).cast("string"), F.lit("k")))
        .alias("salary"),
        _pick(TYPE_TEXTS, n).alias("type_text"),
    )


def parsed_date() -> Column:
    """Posting date by the board's rules, null where its text names none."""
    out = F.lit(None).cast("timestamp")
    for name, parse in D.PARSERS.items():
        out = F.when(F.col("source") == name, parse(F.col("date_text"), as_of())).otherwise(out)
    return out


def tagged_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Postings with the skills of title and description, as a store would take them."""
    raw = raw_postings(spark, sf).withColumns(
        {
            "_title": K.extract_skills(F.col("title")),
            "_description": K.extract_skills(F.col("description")),
            "job_type": job_type(F.concat_ws(" ", "title", "type_text")),
        }
    )
    return raw.select(
        "posting_no",
        "arrival",
        "feed",
        posting_id(F.col("source"), F.col("url"), F.col("title")).alias("posting_id"),
        clean_text(F.col("title")).alias("title"),
        "company",
        clean_location(F.col("location"), F.col("job_type")).alias("location"),
        "description",
        "url",
        salary_if_numeric(F.col("salary")).alias("salary"),
        K.union_skills(F.col("_title"), F.col("_description")).alias("skills"),
        "job_type",
        "source",
        parsed_date().alias("posted_at"),
        as_of().alias("extracted_at"),
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Usability observations (user, task, status, clicks, wrong_clicks, score) from the events."""
    value = F.col("value")
    return read_table(spark, f"{sf}/events.parquet").select(
        F.col("user_id").alias("user"),
        F.col("event_type").alias("task"),
        F.when(value < 100, "C").when(value < 200, "P").otherwise("F").alias("status"),
        (F.floor(value / 50) + 1).alias("clicks"),
        (F.col("event_id") % 4).alias("wrong_clicks"),
        F.least(F.floor(value / 20) + 1, F.lit(5)).alias("score"),
    )
