"""The registered queries: every operator bound to the test tables.

Each query takes (spark, folder of the tables) and reads whole tables. `plans.oracle` has
the same queries in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import dates as D
from postmill.functions import html as H
from postmill.functions import skills as K
from postmill.functions import text as N
from postmill.functions import vocabulary as V
from postmill.functions.jobtype import clean_location, job_type, job_type_from_store, job_type_to_store
from postmill.functions.urls import BASE_URLS, canonical_url, posting_id
from postmill.operators import dedup, enrich, frontier, matching, pages, search, stats
from postmill.operators import dictionary as D2
from postmill.operators import usability as U
from postmill.operators.common import compute_once, explode_once
from postmill.plans import board_pages as B
from postmill.plans import pipeline
from postmill.plans import posting_view as P
from postmill.sources import postings as flat
from postmill.sources import store as S
from postmill.sources.dictionaries import alias_table, role_skills_table
from postmill.sources.pages import read_pages, stream_pages
from postmill.sources.tables import read_table
from postmill.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TIES = ("posting_id", "posting_no")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(names: str | Column) -> Column:
    return F.array_join(names, "|")


def _ts(at: str | Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, f"{sf}/documents.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, f"{sf}/pages.parquet")


def _pages_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every page, assigned to one of the boards."""
    boards = F.array(*map(F.lit, P.SOURCES))
    return _pages(spark, sf).withColumn("source", F.get(boards, (F.col("page_id") % len(P.SOURCES)).cast("int")))


def _stored(df: DataFrame) -> DataFrame:
    """The part of the postings that an earlier run brought."""
    return df.filter(F.col("feed") < "src15")


def _arriving(df: DataFrame) -> DataFrame:
    """The other part."""
    return df.filter(F.col("feed") >= "src15")


# --- tagging and text -----------------------------------------------------------------------


@query
def skill_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", _joined(K.extract_skills(F.col("text"))).alias("skills"))


@query
def skill_tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.skill_counts(_documents(spark, sf).select(K.extract_skills(F.col("text")).alias("skills")))


@query
def skill_tags_by_source(spark: SparkSession, sf: str) -> DataFrame:
    tagged = _documents(spark, sf).select("source", K.extract_skills(F.col("text")).alias("skills"))
    return stats.skill_counts(tagged, "source")


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", N.clean_text(F.col("text")).alias("cleaned"))


@query
def norm_text(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", N.normalize_for_match(F.col("text")).alias("normalized"))


@query
def signature(spark: SparkSession, sf: str) -> DataFrame:
    return P.raw_postings(spark, sf).select("posting_no", N.signature(F.col("title"), F.col("company")).alias("signature"))


@query
def posting_ids(spark: SparkSession, sf: str) -> DataFrame:
    return P.raw_postings(spark, sf).select(
        "posting_no", posting_id(F.col("source"), F.col("url"), F.col("title")).alias("posting_id")
    )


@query
def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    url, key = F.col("url"), F.col("page_id").cast("string")
    forms = {
        "linkedin": ("LinkedIn", url),
        "wuzzuf": ("Wuzzuf", F.concat(F.lit("/jobs/p/"), key, F.lit(" role?o=1"))),
        "indeed": ("Indeed", F.concat(F.lit("/rc/clk?jk="), F.md5(url), F.lit("&from=x"))),
        "indeed_plain": ("Indeed", url),
        "glassdoor": ("Glassdoor", F.concat(F.lit("/job-listing/"), key, F.lit("?jl="), key)),
        "bayt": ("Bayt", url),
    }
    return read_table(spark, f"{sf}/pages.parquet").select(
        "page_id", *[canonical_url(form, F.lit(board)).alias(name) for name, (board, form) in forms.items()]
    )


@query
def url_dedup(spark: SparkSession, sf: str) -> DataFrame:
    keyed = P.raw_postings(spark, sf).select(
        "posting_no", "arrival", canonical_url(F.col("url"), F.lit("LinkedIn")).alias("url")
    )
    return dedup.dedup_urls(keyed).select("posting_no", "url")


@query
def job_types(spark: SparkSession, sf: str) -> DataFrame:
    return P.raw_postings(spark, sf).select(
        "posting_no",
        job_type(F.concat_ws(" ", "title", "type_text", "description")).alias("job_type"),
        job_type(F.concat_ws(" ", "title", "type_text")).alias("short_type"),
    )


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    return P.raw_postings(spark, sf).withColumn("job_type", job_type(F.concat_ws(" ", "title", "type_text")))


@query
def job_type_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    stored = _kinds(spark, sf).select("posting_no", "job_type", job_type_to_store(F.col("job_type")).alias("stored"))
    return stored.withColumn("back", job_type_from_store(F.col("stored")))


@query
def remote_location(spark: SparkSession, sf: str) -> DataFrame:
    return _kinds(spark, sf).select(
        "posting_no", "job_type", clean_location(F.col("location"), F.col("job_type")).alias("location")
    )


@query
def company_and_place_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("c_name")
    place = F.concat(F.lit("City "), F.col("c_nationkey").cast("string"), F.lit(" · 51-200 Employees"))
    return read_table(spark, f"{sf}/customer.parquet").select(
        "c_custkey",
        N.company_bilingual(F.concat(name, F.lit(" / "), "c_mktsegment")).alias("bilingual"),
        N.company_strip_prefix(F.concat(F.lit("Work at Review for "), name)).alias("stripped"),
        N.location_strip_headcount(place).alias("place"),
        N.salary_if_numeric(F.concat(F.col("c_acctbal").cast("string"), F.lit(" EGP"))).alias("salary"),
    )


@query
def description_cut(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("text"), F.lit("\n Easy Apply now. Get contacted by recruiters"))
    last = F.concat(F.col("text"), F.lit(" Email to Friend\nEasy Apply"))
    return _documents(spark, sf).select(
        "doc_id", N.description_cut(text).alias("cut"), N.description_cut(last, last_resort=True).alias("cut_last")
    )


# --- dates ----------------------------------------------------------------------------------


def _dates(source: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = D.PARSERS[source](F.col("date_text"), P.as_of())
        raw = P.raw_postings(spark, sf).select("posting_no", "date_text", found.alias("at"))
        posted = D.with_policy(F.col("at"), source, P.as_of())
        return raw.select(
            "posting_no",
            "date_text",
            _ts("at").alias("parsed"),
            _ts(posted).alias("posted"),
            F.round(D.age_days(posted, P.as_of()), 6).alias("age_days"),
        )

    return run


for _name in D.PARSERS:
    QUERIES[f"relative_dates_{_name.lower()}"] = _dates(_name)


@query
def fresh_only(spark: SparkSession, sf: str) -> DataFrame:
    dated = P.raw_postings(spark, sf).select(
        "posting_no", "source", D.parse_posted(F.col("date_text"), F.col("source"), P.as_of()).alias("posted_at")
    )
    return enrich.fresh_only(compute_once(dated, "posted_at"), P.as_of()).select("posting_no", "source", _ts("posted_at").alias("posted"))


# --- classification and imputation ----------------------------------------------------------


@query
def seniority(spark: SparkSession, sf: str) -> DataFrame:
    return P.raw_postings(spark, sf).select("posting_no", K.detect_seniority(F.col("title")).alias("seniority"))


@query
def roles(spark: SparkSession, sf: str) -> DataFrame:
    return P.raw_postings(spark, sf).select("posting_no", _joined(K.detect_roles(F.col("title"))).alias("roles"))


@query
def implied_skills(spark: SparkSession, sf: str) -> DataFrame:
    title = F.col("title")
    titled = P.raw_postings(spark, sf).select("posting_no", "title", K.detect_seniority(title).alias("level"))
    detected = explode_once(titled, ["posting_no", "level"], K.detect_roles(title), "role")
    dictionary = role_skills_table(spark)
    implied = enrich.implied_skills(enrich.known_roles_only(detected, dictionary), dictionary)
    return implied.select("posting_no", "role", "level", "skill", "skill_pos.level_rank", "skill_pos.pos")


def _enhanced(spark: SparkSession, sf: str) -> DataFrame:
    tagged = P.tagged_postings(spark, sf).select("posting_no", "title", F.col("skills").alias("extracted"))
    return enrich.with_enhancement(tagged)


@query
def enhanced_skills(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("enhanced")
    return _enhanced(spark, sf).select(
        "posting_no",
        _joined(e["roles"]).alias("roles"),
        e["seniority"].alias("seniority"),
        _joined(e["extracted"]).alias("extracted"),
        _joined(e["final"]).alias("final"),
    )


@query
def enhancement_report(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.enhancement_report(_enhanced(spark, sf))


@query
def source_policy(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.with_source_skills(P.raw_postings(spark, sf)).select("posting_no", "source", _joined("skills").alias("skills"))


@query
def alias_lookup(spark: SparkSession, sf: str) -> DataFrame:
    words = P.raw_postings(spark, sf).select(
        "posting_no", F.explode(F.split(N.normalize_for_match(F.col("title")), " ")).alias("word")
    )
    named = enrich.alias_lookup(words, alias_table(spark), skill="word")
    return named.groupBy("posting_no", "word", "canonical").agg(F.count("*").alias("n"))


def _big_dictionary(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A role dictionary with hundreds of roles besides the known ones, and aliases for half of its skills."""
    part = read_table(spark, f"{sf}/part.parquet")
    number = (F.col("p_partkey") % 400).cast("int")
    known = F.array(*[F.lit(r.name) for r in V.ROLES])
    skill = F.concat_ws("-", "p_brand", (F.col("p_size") % 7).cast("string"))
    rows = part.select(
        F.coalesce(F.get(known, number), F.concat(F.lit("role "), number.cast("string"))).alias("role"),
        (F.col("p_size") % 3).alias("level_rank"), F.col("p_partkey").alias("pos"), skill.alias("skill"),
    )
    named = part.filter("p_size % 2 = 0").groupBy(F.lower(skill).alias("alias")).agg(F.min("p_type").alias("canonical"))
    return rows, named.unionByName(alias_table(spark))


@query
def enhanced_by_tables(spark: SparkSession, sf: str) -> DataFrame:
    """K7 with dictionaries that are tables."""
    tagged = P.tagged_postings(spark, sf).select("posting_no", "title", F.col("skills").alias("extracted"))
    e = F.col("enhanced")
    return D2.enhance_by_tables(tagged, *_big_dictionary(spark, sf), key="posting_no").select(
        "posting_no", _joined(e["roles"]).alias("roles"), e["seniority"].alias("seniority"),
        _joined(e["extracted"]).alias("extracted"), _joined(e["implied"]).alias("implied"), _joined(e["final"]).alias("final"),
    )


@query
def skills_by_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """K1 with the built-in phrases and the places as one dictionary table."""
    nations = read_table(spark, f"{sf}/nation.parquet").select(
        F.concat(F.lit("Place "), "n_name").alias("skill"), (F.col("n_nationkey") + 1000).cast("int").alias("rank"), F.lower("n_name").alias("phrase")
    )
    text = F.concat_ws("\n", "title", "location", "description").alias("text")
    view = P.raw_postings(spark, sf).select("posting_no", text)
    found = D2.tag_by_phrases(view, D2.phrase_table(spark).unionByName(nations), "posting_no")
    return found.select("posting_no", _joined("skills").alias("skills"))


SEEKER_SKILLS = ("React", "SQL", "AWS", "Docker", "Node.js", "Java", "C++", "Kubernetes", "REST API", "GraphQL", "Machine Learning", "TypeScript", "Big Data")


@query
def match_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as seekers of the postings; rarer trades weigh more."""
    n, c = len(SEEKER_SKILLS), F.col("c_custkey")
    names = F.array(*map(F.lit, SEEKER_SKILLS))
    has = F.transform(F.sequence(F.lit(0), (c % 6 + 2).cast("int")), lambda i: F.get(names, ((c * 5 + i * (c % 3 + 1)) % n).cast("int")))
    seekers = read_table(spark, f"{sf}/customer.parquet").select(c.alias("seeker"), has.alias("skills"))
    weights = spark.createDataFrame([(name, 1 + i % 4) for i, name in enumerate(SEEKER_SKILLS)], "skill string, w int")
    postings = P.tagged_postings(spark, sf).select("posting_no", "skills")
    found = matching.match_topk(postings, seekers, k=5, min_score=60, weights=weights, split_rows=200)
    return found.withColumn("score", F.col("score").cast("string"))


# --- deduplication --------------------------------------------------------------------------


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    raw = P.raw_postings(spark, sf).select("posting_no", "arrival", "feed", "title", "company", "source", "url")
    return dedup.dedup_run(_arriving(raw), _stored(raw).select("url"))


@query
def dedup_run(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select(
        "posting_no",
        N.signature(F.col("title"), F.col("company")).alias("signature"),
        "url",
        "status",
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


@query
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """A board that found nothing and one whose fetching failed are among the run's boards."""
    boards = spark.createDataFrame([(name,) for name in (*P.SOURCES, "Silent")], "source string")
    failed = spark.createDataFrame([("Bayt",)], "source string")
    found = _judged(spark, sf).filter(F.col("source") != "Glassdoor")
    return stats.run_counters(found, boards, failed)


@query
def observed_counters(spark: SparkSession, sf: str) -> DataFrame:
    """The same counters and the refused rows, observed while the run is written; one board's fetching failed,
    another one found nothing."""
    raw = P.tagged_postings(spark, sf).withColumn("url", F.when(F.col("posting_no") % 11 != 4, F.col("url")).otherwise(""))
    some = raw.filter(F.col("source") != "Indeed")
    metrics = stats.RunMetrics(P.SOURCES)
    judged = metrics.watch(dedup.dedup_run(_arriving(some), _stored(some).filter("url <> ''").select("url")), S.refusal())
    store = S.PostingStore(spark, f"{ingest.shared_folder(spark)}/star")
    store.append(judged.filter(F.col("status") == "saved"), _run_time(1), "1")
    return metrics.by_source(spark, failed=["LinkedIn"])


@query
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return stats.run_totals(_judged(spark, sf))


@query
def new_and_known_urls(spark: SparkSession, sf: str) -> DataFrame:
    raw = P.raw_postings(spark, sf).select("posting_no", "feed", "url")
    arriving, stored = _arriving(raw), _stored(raw)
    fresh = dedup.new_urls(arriving, stored).withColumn("state", F.lit("new"))
    known = dedup.known_urls(arriving, stored).withColumn("state", F.lit("known"))
    return dedup.append_sources(fresh, known).select("posting_no", "state")


# --- stores ---------------------------------------------------------------------------------


def _run_time(day: int) -> Column:
    return F.lit(f"2024-04-0{day} 00:00:00").cast("timestamp")


def _star(spark: SparkSession, sf: str) -> S.Star:
    """The store on disk after two batches."""
    store = S.PostingStore(spark, f"{ingest.shared_folder(spark)}/star")
    tagged = P.tagged_postings(spark, sf)
    store.append(_stored(tagged), _run_time(1), "1")
    store.append(_arriving(tagged), _run_time(2), "2")
    return store.read()


def _batch(at: str) -> Column:
    return F.dayofmonth(at).cast("int")


@query
def upsert_star_postings(spark: SparkSession, sf: str) -> DataFrame:
    return _star(spark, sf).postings.select(
        "posting_id", "url", "source", "title", "company_name", "location", "salary", "job_type",
        F.md5("description").alias("description"),
        _ts("posted_at").alias("posted_at"),
        _batch("created_at").alias("created"),
        _batch("updated_at").alias("updated"),
    )


@query
def upsert_star_skills(spark: SparkSession, sf: str) -> DataFrame:
    return _star(spark, sf).skills.select(
        "skill_id", "name", _batch("created_at").alias("created"), _batch("updated_at").alias("updated")
    )


@query
def upsert_star_links(spark: SparkSession, sf: str) -> DataFrame:
    return _star(spark, sf).links.select("posting_id", "skill_id", _batch("created_at").alias("created"))


@query
def star_readback(spark: SparkSession, sf: str) -> DataFrame:
    return S.assemble(_star(spark, sf), P.as_of()).select(
        "posting_id", "title", "company", "location", "url", "salary", _joined("skills").alias("skills"),
        "job_type", "source", _ts("posted_at").alias("posted_at"),
    )


@query
def search_star(spark: SparkSession, sf: str) -> DataFrame:
    found = S.search_star(_star(spark, sf), ["react", "sql"], P.as_of())
    return found.select("posting_id", "title", _joined("skills").alias("skills"), _ts("posted_at").alias("posted_at"))


@query
def replace_flat(spark: SparkSession, sf: str) -> DataFrame:
    # Staged: the decisions read keys several times, the texts behind them once.
    shown = P.tagged_postings(spark, sf).select("arrival", "feed", "posting_id", "url", "title", "skills")
    tagged = ingest.staged(shown, f"{ingest.shared_folder(spark)}/tagged")
    before = _stored(tagged).drop("feed")
    last = before.groupBy("url").agg(F.max("arrival").alias("arrival")).select("arrival")
    stored = before.join(last, "arrival", "left_semi").drop("arrival")
    after = flat.replace_flat(stored, _arriving(tagged).drop("feed"))
    return after.select("posting_id", "url", "title", _joined("skills").alias("skills"))


@query
def flat_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = flat.to_flat(P.tagged_postings(spark, sf), _run_time(1))
    return flat.from_flat(rows).select("posting_id", _joined("skills").alias("skills"), _ts("posted_at").alias("posted_at"))


@query
def source_registry(spark: SparkSession, sf: str) -> DataFrame:
    raw = P.raw_postings(spark, sf).select("feed", "source", P.as_of().alias("extracted_at"))
    before = S.registry_rows(_stored(raw), BASE_URLS)
    after = S.registry_rows(_arriving(raw), BASE_URLS)
    return S.upsert_source_registry(before, after).select("name", "url", "is_active", "total")


# --- search and counts ----------------------------------------------------------------------


def _shown(df: DataFrame, with_skills: bool = True) -> DataFrame:
    skills = [_joined("skills").alias("skills")] if with_skills else []
    return df.select("posting_id", "posting_no", "title", _ts("posted_at").alias("posted_at"), *skills)


def _searchable(spark: SparkSession, sf: str) -> DataFrame:
    return compute_once(P.tagged_postings(spark, sf), "skills")


@query
def by_skills_substring(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(search.by_skills_substring(_searchable(spark, sf), ["react", "sql"], ties=TIES))


@query
def by_skills_keep_all(spark: SparkSession, sf: str) -> DataFrame:
    wanted = search.csv_param("java, ")
    found = search.by_skills_substring(_searchable(spark, sf), wanted, keep_all_skills=True, ties=TIES)
    return _shown(found)


@query
def by_skills_element(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(search.by_skills_element(_searchable(spark, sf), ["Java", "aws"], ties=TIES))


@query
def search_default(spark: SparkSession, sf: str) -> DataFrame:
    f = search.SearchFilter(job_type="remote")  # fields other than skills do not count by default
    return _shown(search.search(P.tagged_postings(spark, sf), f, ties=TIES), with_skills=False)


@query
def search_filters(spark: SparkSession, sf: str) -> DataFrame:
    f = search.SearchFilter(
        location="nation", company="customer", job_type="full-time",
        min_salary=60_000, max_salary=120_000, date_posted="month",
    )
    found = search.search(P.tagged_postings(spark, sf), f, honour_all=True, as_of=P.as_of(), ties=TIES)
    return _shown(found, with_skills=False)


@query
def recent_postings(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(search.recent_postings(P.tagged_postings(spark, sf), nulls_first=False, ties=TIES), with_skills=False)


@query
def recent_nulls_first(spark: SparkSession, sf: str) -> DataFrame:
    dated = read_table(spark, f"{sf}/orders.parquet").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("posted_at")
    )
    newest = search.recent_postings(dated, ties=("o_orderkey",))
    return newest.select("o_orderkey", F.date_format("posted_at", "yyyy-MM-dd").alias("posted_at"))


@query
def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, f"{sf}/documents.parquet").select("doc_id", "source")
    return search.random_sample(docs, 50, "doc_id", seed=7)


@query
def stats_total(spark: SparkSession, sf: str) -> DataFrame:
    return stats.count_all(read_table(spark, f"{sf}/documents.parquet"))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.count_by_source(read_table(spark, f"{sf}/documents.parquet"))


QUERIES["stats"] = _stats


@query
def stats_map(spark: SparkSession, sf: str) -> DataFrame:
    one = stats.stats_map(read_table(spark, f"{sf}/documents.parquet"))
    entries = F.transform(F.map_entries("by_source"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return one.select("total", _joined(entries).alias("by_source"))


@query
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return search.skill_vocabulary(P.tagged_postings(spark, sf), ties=TIES)


@query
def distinct_skills(spark: SparkSession, sf: str) -> DataFrame:
    return search.distinct_skills(P.tagged_postings(spark, sf))


@query
def envelope(spark: SparkSession, sf: str) -> DataFrame:
    return flat.result_envelope(_stats(spark, sf).orderBy("source"), limit=1000, name="sources")


@query
def window_handoff(spark: SparkSession, sf: str) -> DataFrame:
    since, until = search.recent_window(datetime(2024, 1, 10), minutes=3 * 24 * 60)
    events = read_table(spark, f"{sf}/events.parquet")
    return search.in_window(events, F.lit(since), F.lit(until), column="ts").select("event_id", "event_type")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run windows of every length, many overlapping, some empty: one per part."""
    part = read_table(spark, f"{sf}/part.parquet")
    since = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("p_partkey") % 1000 * 3000)
    minutes = F.when(F.col("p_partkey") % 50 == 0, 20_000).otherwise((F.col("p_size") - 5) * 7)
    until = F.timestamp_seconds(F.unix_seconds(since) + minutes * 60)
    return part.select(F.col("p_partkey").alias("run_id"), since.alias("since"), until.alias("until"))


@query
def windows_handoff(spark: SparkSession, sf: str) -> DataFrame:
    """What each of many runs hands over: the events inside its window."""
    events = read_table(spark, f"{sf}/events.parquet").select("event_id", "event_type", "ts")
    number = F.col("event_id")
    totals = {"n": (F.sum, F.lit(1)), "first_id": (F.min, number), "last_id": (F.max, number), "id_sum": (F.sum, number)}
    held = search.in_windows(events, _runs(spark, sf), column="ts", totals=totals, by=["event_type"])
    return held.groupBy("run_id").agg(
        F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"),
        F.sum("id_sum").alias("id_sum"), F.count_distinct("event_type").alias("types"),
    )


def _hourly(counts: DataFrame) -> DataFrame:
    return counts.select(_ts("window_start").alias("window_start"), "event_type", "n")


@query
def hourly_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _hourly(ingest.counts_by_window(read_table(spark, f"{sf}/events.parquet"), "ts", "event_type"))


@query
def source_append(spark: SparkSession, sf: str) -> DataFrame:
    raw = P.raw_postings(spark, sf).select("feed", "source", "url")
    both = dedup.append_sources(_stored(raw), _arriving(raw))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query
def url_union(spark: SparkSession, sf: str) -> DataFrame:
    raw = P.raw_postings(spark, sf).select("feed", "url")
    return dedup.union_distinct(_stored(raw).select("url"), _arriving(raw).select("url"))


@query
def skill_difference(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("enhanced")
    return _enhanced(spark, sf).select(
        "posting_no", _joined(dedup.array_new_only(e["implied"], e["extracted"])).alias("added")
    )


@query
def frontier_by_board(spark: SparkSession, sf: str) -> DataFrame:
    terms = read_table(spark, f"{sf}/part.parquet").select(F.col("p_name").alias("term"))
    places = read_table(spark, f"{sf}/nation.parquet").select(F.col("n_name").alias("location"))
    plans = [
        frontier.search_frontier(terms, places, board, n_terms=5, per_term=2, total=10, seed=k).withColumn("source", F.lit(board))
        for k, board in enumerate(P.SOURCES)
    ]
    return dedup.append_sources(*plans)


# --- pages ----------------------------------------------------------------------------------


@query
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    flattened = pages.with_page(_pages_of_sources(spark, sf))
    return flattened.select("page_id", F.expr(H.first_text("page", H.lits(["h1"]))).alias("title"))


@query
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    links = F.filter("page.els", lambda e: e["href"].isNotNull())
    rows = pages.with_page(_pages_of_sources(spark, sf)).select("page_id", "page", F.explode(links).alias("a"))
    return rows.select(
        "page_id", F.col("a.href").alias("href"), F.expr(H.trimmed(H.text_of("page", "a.idx"))).alias("text")
    )


@query
def blocked_pages(spark: SparkSession, sf: str) -> DataFrame:
    blocked = pages.is_blocked(F.col("html"), F.col("source"))
    return _pages_of_sources(spark, sf).select("page_id", "source", blocked.alias("blocked"))


def _crawl(spark: SparkSession, sf: str) -> DataFrame:
    """The detail pages of the posting view, stored as a crawl and read back."""
    path = f"{ingest.shared_folder(spark)}/crawl"
    _dealt(B.detail_pages(spark, sf)).select("page_id", "url", "html").write.parquet(path)
    return _with_board(read_pages(spark, path))


def _dealt(pages_: DataFrame) -> DataFrame:
    """Pages over all tasks and files, however few row groups the documents came in: parsing them costs most."""
    return pages_.repartition("page_id")


def _with_board(pages_: DataFrame) -> DataFrame:
    boards = F.array(*map(F.lit, P.SOURCES))
    return pages_.withColumn("source", F.get(boards, (F.col("page_id") % len(P.SOURCES)).cast("int")))


@query
def page_details(spark: SparkSession, sf: str) -> DataFrame:
    found = pages.detail_fields(_crawl(spark, sf))
    return found.withColumns({"page_tags": _joined("page_tags"), "description": F.md5("description")})


@query
def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The raw web pages, which hold no markup of a board: the rules' last answers."""
    found = pages.detail_fields(_pages_of_sources(spark, sf))
    return found.select("page_id", "source", "url", "title", "company", "location")


@query
def page_longest_text(spark: SparkSession, sf: str) -> DataFrame:
    """X8 and the rules around it, on the elements that hold a description."""
    flattened = pages.with_page(_crawl(spark, sf), {name: {"any": CONTAINERS} for name in P.SOURCES})
    return flattened.select("page_id", F.md5(F.expr(H.longest_text("page", "''", H.lits(CONTAINERS)))).alias("text"))


CONTAINERS = ["main", "article", "#job-details", "div[class*='job-']", "div.t-break"]


@query
def listing_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages.listing_to_links(_stored_listings(spark, sf), P.as_of())


def _stored_listings(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{ingest.shared_folder(spark)}/listings"
    B.listing_pages(spark, sf).select("page_id", "url", "html").write.parquet(path)
    return _with_board(read_pages(spark, path))


@query
def listing_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Glassdoor's cards as whole postings."""
    cards = _stored_listings(spark, sf).filter(F.col("source") == "Glassdoor")
    found = pages.listing_to_postings(cards, P.as_of())
    return found.select(
        "arrival.page_id", "arrival.pos", "url", "title", "company", "location", "description", "salary", "skills_line",
        _ts("posted_at").alias("posted_at"),
    )


@query
def listing_detail_fallback(spark: SparkSession, sf: str) -> DataFrame:
    listing = P.raw_postings(spark, sf).select("posting_no", "url", "title")
    heading = F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)
    detail = read_table(spark, f"{sf}/pages.parquet").select("page_id", "url", heading.alias("title"))
    merged = pages.detail_or_listing(listing, detail, ["title"], order="page_id")
    return merged.select("posting_no", "url", F.md5("title").alias("title"), "from_detail")


def _whole(found: DataFrame, *more: Column | str) -> DataFrame:
    return found.select(
        "posting_id", "title", "company", "location", F.md5("description").alias("description"), "url", "salary",
        _joined("skills").alias("skills"), "job_type", "source", _ts("posted_at").alias("posted_at"), *more,
    )


@query
def pages_to_postings(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(pipeline.pages_to_postings(_crawl(spark, sf), P.as_of()), "arrival")


def _state(store: S.PostingStore) -> DataFrame:
    """The store read back, every field."""
    return _whole(S.assemble(store.read(), P.as_of()))


@query
def pages_to_store(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of all pages into an empty store."""
    store = S.PostingStore(spark, f"{ingest.shared_folder(spark)}/star")
    pipeline.run(_crawl(spark, sf), store, P.as_of(), "all")
    return _state(store)


@query
def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a url or a title are kept apart, with the reason."""
    store = S.PostingStore(spark, f"{ingest.shared_folder(spark)}/star")
    no = F.col("posting_no")
    broken = P.tagged_postings(spark, sf).withColumns(
        {"url": F.when(no % 10 != 3, F.col("url")), "title": F.when(no % 10 != 5, F.col("title")).otherwise("")}
    )
    store.append(broken, _run_time(1), "1")
    return store.rejected().select("arrival", "title", "company", "url", "reason", _joined("skills").alias("skills"))


# --- usability metrics ----------------------------------------------------------------------


@query
def completion_rate_by_user(spark: SparkSession, sf: str) -> DataFrame:
    return U.completion_rate_by_user(P.observations(spark, sf))


@query
def completion_rate_overall(spark: SparkSession, sf: str) -> DataFrame:
    return U.completion_rate_overall(P.observations(spark, sf))


@query
def completion_rate_by_task(spark: SparkSession, sf: str) -> DataFrame:
    return U.completion_rate_by_task(P.observations(spark, sf))


@query
def click_quality(spark: SparkSession, sf: str) -> DataFrame:
    return U.click_quality(P.observations(spark, sf))


def _expected_clicks(seen: DataFrame) -> DataFrame:
    return seen.filter(F.col("status") == "C").groupBy("task").agg((F.max("clicks") - 1).alias("expected"))


@query
def task_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    seen = P.observations(spark, sf)
    return U.task_efficiency(seen, _expected_clicks(seen))


@query
def pivot_clicks(spark: SparkSession, sf: str) -> DataFrame:
    seen = P.observations(spark, sf)
    return U.click_matrix(seen, _expected_clicks(seen))


@query
def clicks_by_task_user(spark: SparkSession, sf: str) -> DataFrame:
    """The same in long form."""
    seen = P.observations(spark, sf)
    return U.click_cells(seen, _expected_clicks(seen))


@query
def pivot_status(spark: SparkSession, sf: str) -> DataFrame:
    seen = P.observations(spark, sf)
    return U.matrix(seen, "user", "task", U.names_of(seen, "task"), "status")


@query
def likert(spark: SparkSession, sf: str) -> DataFrame:
    return U.likert_summary(P.observations(spark, sf), "task")


# --- streams --------------------------------------------------------------------------------


def _posting_stream(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """The tagged posting view replayed as files that arrive, whole texts and skills included."""
    table = P.tagged_postings(spark, sf).drop("posting_no", "feed", "posting_id")
    table.write.parquet(f"{folder}/arrivals")
    return spark.readStream.schema(table.schema).parquet(f"{folder}/arrivals")


@query
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first whole row of each signature over three micro-batches, restarted in between, of urls that an
    earlier run did not store."""
    folder = ingest.shared_folder(spark)
    table = ingest.staged(P.tagged_postings(spark, sf), f"{folder}/tagged")
    store = S.PostingStore(spark, f"{folder}/star")
    store.append(_stored(table), _run_time(1), "earlier")
    arriving = _arriving(table).drop("posting_no", "feed", "posting_id", "extracted_at")
    stream = spark.readStream.schema(arriving.schema).parquet(f"{folder}/arrivals/part=*")
    stamped = stream.withColumn("extracted_at", P.as_of())
    kept = ingest.stream_first_rows(stamped, store.urls())
    for k in range(3):
        arriving.filter(F.col("arrival") % 3 == k).write.parquet(f"{folder}/arrivals/part={k}")
        found = ingest.drain_to_table(kept, folder, "kept")
    return found.select(
        "arrival", "signature", "url", "title", "company", "location", "source", "job_type", "salary",
        F.md5("description").alias("description"), _joined("skills").alias("skills"), _ts("posted_at").alias("posted_at"),
    )


@query
def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """postings of the last week, from a stream."""
    folder = ingest.shared_folder(spark)
    young = ingest.drop_late(_posting_stream(spark, sf, folder), 7, P.as_of())
    return ingest.drain_to_table(young.select("arrival", "url", _ts("posted_at").alias("posted_at")), folder, "young")


@query
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Finished postings as a stream; all columns of the store."""
    folder = ingest.shared_folder(spark)
    arrivals = _posting_stream(spark, sf, folder)
    ingest.stream_ingest(arrivals, folder, f"{folder}/checkpoint", P.as_of).awaitTermination()
    state = S.PostingStore(spark, f"{folder}/star").read()
    n_skills = state.links.groupBy("posting_id").agg(F.count("*").alias("n_skills"))
    return state.postings.join(n_skills, "posting_id", "left").select(
        "posting_id", "url", "source", "title", F.col("company_name").alias("company"), "location", "salary", "job_type",
        F.md5("description").alias("description"), _ts("posted_at").alias("posted_at"),
        F.coalesce("n_skills", F.lit(0)).alias("n_skills"),
    )


@query
def stream_after_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A store filled by a batch, then by a stream of four micro-batches; the run whose window holds each row."""
    folder = ingest.shared_folder(spark)
    tagged = P.tagged_postings(spark, sf)
    store = S.PostingStore(spark, f"{folder}/star")
    store.append(_stored(tagged), _run_time(1), "first")
    arrivals = _arriving(tagged).drop("feed", "posting_id", "posting_no")
    stream = spark.readStream.schema(arrivals.schema).parquet(f"{folder}/arrivals/part=*")
    for k in range(4):  # each slice arrives, and is drained, after the one before
        arrivals.filter(F.col("arrival") % 4 == k).write.parquet(f"{folder}/arrivals/part={k}")
        ingest.stream_ingest(stream, folder, f"{folder}/checkpoint").awaitTermination()
    state = store.read()
    runs = ingest.read_runs(spark, folder).select("since", "until", (F.col("run_id").cast("int") + 1).alias("run"))
    held = search.in_windows(state.postings.select("posting_id", "created_at"), runs).select("posting_id", "run")
    n_skills = state.links.groupBy("posting_id").agg(F.count("*").alias("n_skills"))
    rows = state.postings.join(held, "posting_id", "left").join(n_skills, "posting_id", "left")
    return rows.select(
        "posting_id", "url", F.coalesce("run", F.lit(0)).alias("run"),
        F.md5("description").alias("description"), F.coalesce("n_skills", F.lit(0)).alias("n_skills"),
    )


PAGE_BATCHES = 3


def _streamed_pages(spark: SparkSession, sf: str, folder: str) -> S.PostingStore:
    """The crawl arriving as three micro-batches of files over a store that earlier feeds filled."""
    crawl = ingest.staged(_dealt(B.detail_pages(spark, sf)), f"{folder}/crawl")
    store = S.PostingStore(spark, f"{folder}/star")
    pipeline.run(crawl.filter(F.col("feed") < "src05"), store, P.as_of(), "earlier")
    arriving = crawl.filter(F.col("feed") >= "src05").select("page_id", "url", "html")
    stream = _with_board(stream_pages(spark, f"{folder}/pages/part=*", files_per_batch=2**31 - 1))
    for k in range(PAGE_BATCHES):  # each part arrives, and is drained, after the one before; all its files are one batch
        arriving.filter(F.col("page_id") % PAGE_BATCHES == k).write.parquet(f"{folder}/pages/part={k}")
        pipeline.stream_pages_to_store(stream, folder, f"{folder}/checkpoint", P.as_of).awaitTermination()
    return store


@query
def stream_pages_to_store(spark: SparkSession, sf: str) -> DataFrame:
    return _state(_streamed_pages(spark, sf, ingest.shared_folder(spark)))


@query
def stream_page_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of those micro-batches: pages that came, pages that were extracted (those of new urls), rows."""
    folder = ingest.shared_folder(spark)
    _streamed_pages(spark, sf, folder)
    runs = ingest.read_runs(spark, folder)
    return runs.select("run_id", "pages", "extracted", "fetched", "saved", "duplicates", "rejected")


@query
def stream_hourly_counts(spark: SparkSession, sf: str) -> DataFrame:
    folder = ingest.shared_folder(spark)
    events = read_table(spark, f"{sf}/events.parquet").select("ts", "event_type")
    # A last row far ahead moves the watermark past every window; its own window never closes.
    end = events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).withColumn("event_type", F.lit(""))
    events.write.parquet(f"{folder}/events/part=1")
    end.write.parquet(f"{folder}/events/part=2")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events/part=*")
    return _hourly(ingest.drain_to_table(ingest.counts_by_window(stream, "ts", "event_type"), folder, "counts"))
