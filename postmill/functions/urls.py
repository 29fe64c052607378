"""Posting identity and canonical urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import SPACE, trim_all

# Address of each board.
BASE_URLS = {
    "LinkedIn": "https://www.linkedin.com",
    "Wuzzuf": "https://wuzzuf.net",
    "Indeed": "https://www.indeed.com",
    "Glassdoor": "https://www.glassdoor.com",
    "Bayt": "https://www.bayt.com",
}


def posting_id(source: Column, url: Column, title: Column) -> Column:
    """Source name plus md5 of url and raw title."""
    name = F.regexp_replace(F.lower(source), f"{SPACE}+", "_")
    return F.concat(name, F.lit("_"), F.md5(F.concat(url, F.lit("-"), title)))


def _absolute(url: Column, base: str) -> Column:
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit(base), url))


def canonical_url(url: Column, source: Column) -> Column:
    """The url a posting is keyed by; null where the link carries no posting id."""
    bare = F.substring_index(url, "?", 1)
    key = F.nullif(F.regexp_extract(url, r"[?&]jk=([a-zA-Z0-9]+)", 1), F.lit(""))
    return (
        F.when(source == "LinkedIn", bare)
        .when(source == "Wuzzuf", _absolute(F.regexp_replace(trim_all(bare), f"{SPACE}+", "-"), BASE_URLS["Wuzzuf"]))
        .when(source == "Indeed", F.concat(F.lit(BASE_URLS["Indeed"] + "/viewjob?jk="), key))
        .when(source == "Glassdoor", _absolute(trim_all(url), BASE_URLS["Glassdoor"]))
        .when(source == "Bayt", _absolute(url, BASE_URLS["Bayt"]))
        .otherwise(url)
    )
