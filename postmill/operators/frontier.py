"""Planning which searches a crawl would run (S10, W4, J6). Nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.text import SPACE


def kebab(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), f"{SPACE}+", "-")


def _component(text: Column) -> Column:
    """Percent-encoding with %20 for blanks."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def search_url(source: Column, term: Column, location: Column, position: Column) -> Column:
    """Search address of a board. LinkedIn alternates two time ranges by position."""
    span = F.when(position % 2 == 0, "r86400").otherwise("r259200")
    glassdoor = (
        "https://www.glassdoor.com/Job/jobs.htm?suggestCount=0&suggestChosen=false&clickSource=searchBtn"
        "&typedKeyword=%s&sc.keyword=%s&locT=C&locId=&jobType=&context=Jobs&dropdown=0"
    )
    t, loc = _component(term), _component(location)
    return (
        F.when(
            source == "LinkedIn",
            F.concat(
                F.lit("https://www.linkedin.com/jobs/search?keywords="), F.url_encode(term),
                F.lit("&location="), F.url_encode(location), F.lit("&f_TPR="), span, F.lit("&f_JT=F&sortBy=DD"),
            ),
        )
        .when(
            source == "Indeed",
            F.concat(F.lit("https://www.indeed.com/jobs?q="), t, F.lit("&l="), loc, F.lit("&fromage=7&sort=date")),
        )
        .when(source == "Wuzzuf", F.concat(F.lit("https://wuzzuf.net/search/jobs/?q="), kebab(term)))
        .when(source == "Glassdoor", F.format_string(glassdoor, t, t))
        .when(
            source == "Bayt",
            F.concat(F.lit("https://www.bayt.com/en/"), kebab(location), F.lit("/jobs/"), kebab(term), F.lit("-jobs/")),
        )
    )


def shuffled_head(df: DataFrame, column: str, k: int, seed: int) -> DataFrame:
    """The first k distinct values in a reproducible random order."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(column)))
    return df.select(column).distinct().orderBy(order, column).limit(k)


def search_frontier(
    terms: DataFrame,
    locations: DataFrame,
    source: str,
    n_terms: int = 5,
    per_term: int = 2,
    total: int = 10,
    seed: int = 0,
) -> DataFrame:
    """Searches in order: up to `n_terms` terms, `per_term` locations each, `total` in all.

    `terms(term)` and `locations(location)` may be big; only the capped heads are combined,
    the locations as one short array that every term explodes.
    """
    order = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), F.col(c)))
    chosen = shuffled_head(locations, "location", per_term, seed)
    places = chosen.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(order("location").alias("o"), "location"))), lambda s: s["location"]
        ).alias("places")
    )
    head = shuffled_head(terms, "term", n_terms, seed)
    # The window only ever sees the n_terms rows of the head.
    ranked = head.withColumn("term_rank", F.row_number().over(W.orderBy(order("term"), "term")))
    placed = ranked.withColumn("places", places.scalar())
    pairs = placed.select("term", "term_rank", F.size("places").alias("n"), F.posexplode("places").alias("place_rank", "location"))
    # Every term has the same places, fewer than `per_term` where there are not as many: no gaps.
    position = (F.col("term_rank") - 1) * F.col("n") + F.col("place_rank")
    return (
        pairs.select(position.alias("position"), "term", "location")
        .filter(F.col("position") < total)
        .withColumn("url", search_url(F.lit(source), F.col("term"), F.col("location"), F.col("position")))
    )
