"""Reading queries."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.operators.common import explode_once

RECENT_LIMIT = 1000
API_LIMIT = 100


def parse_limit(value: str | int | None, default: int = API_LIMIT) -> int:
    """The leading whole number; missing, unreadable or zero gives the default, negative limits are refused."""
    leading = re.match(r"\s*([+-]?[0-9]+)", str(value))
    limit = int(leading[1]) if leading else 0
    if limit < 0:
        raise ValueError("limit must not be negative")
    return limit or default


def csv_param(value: str) -> list[str]:
    """Comma-separated names, trimmed. Empty names would match everything and are dropped."""
    return [s.strip() for s in value.split(",") if s.strip()]


def recent_order(nulls_first: bool = True, ties: Sequence[str] = ("posting_id",)) -> list[Column]:
    """Newest first. The star store puts undated postings first, the flat store last.
    `ties` makes the order total."""
    posted = F.col("posted_at")
    return [posted.desc_nulls_first() if nulls_first else posted.desc_nulls_last(), *map(F.col, ties)]


def recent_postings(
    df: DataFrame, limit: int = RECENT_LIMIT, nulls_first: bool = True, ties: Sequence[str] = ("posting_id",)
) -> DataFrame:
    """The newest postings."""
    return df.orderBy(*recent_order(nulls_first, ties)).limit(limit)


def by_skills_substring(
    df: DataFrame,
    skills: Sequence[str],
    limit: int = API_LIMIT,
    keep_all_skills: bool = False,
    ties: Sequence[str] = ("posting_id",),
) -> DataFrame:
    """Postings with a skill that contains any of the texts (``%`` and ``_`` are wildcards).

    The skill list shown is cut to the matching skills unless `keep_all_skills`.
    """
    if not skills:
        return recent_postings(df, limit, ties=ties)
    matches = F.filter("skills", lambda s: reduce(or_, [s.ilike(f"%{x}%") for x in skills]))
    hit = df.filter(F.size(matches) > 0)
    shown = hit if keep_all_skills else hit.withColumn("skills", matches)
    return recent_postings(shown, limit, ties=ties)


def by_skills_element(
    df: DataFrame, skills: Sequence[str], limit: int = API_LIMIT, ties: Sequence[str] = ("posting_id",)
) -> DataFrame:
    """Postings with one of the skills as a whole element, case ignored; all skills shown."""
    if not skills:
        raise ValueError("at least one skill is needed")
    wanted = [s.lower() for s in skills]
    hit = df.filter(F.exists("skills", lambda s: F.lower(s).isin(wanted)))
    return recent_postings(hit, limit, nulls_first=False, ties=ties)


@dataclass(frozen=True)
class SearchFilter:
    """The search request. Only `skills` is honoured unless `search(..., honour_all=True)`."""

    skills: tuple[str, ...] = ()
    location: str | None = None
    job_type: str | None = None
    company: str | None = None
    min_salary: float | None = None
    max_salary: float | None = None
    date_posted: str | None = None  # today | week | month


_DATE_DAYS = {"today": 1, "week": 7, "month": 30}


def salary_numbers(salary: Column) -> Column:
    """Amounts named in a salary text; a trailing k stands for thousands."""
    found = F.regexp_extract_all(F.lower(F.regexp_replace(salary, ",", "")), F.lit(r"([0-9]+(?:\.[0-9]+)?k?)"))
    return F.transform(
        found,
        lambda n: F.regexp_replace(n, "k", "").cast("double") * F.when(F.endswith(n, F.lit("k")), 1000.0).otherwise(1.0),
    )


def _extra_predicates(f: SearchFilter, as_of: Column | None) -> list[Column]:
    amounts = salary_numbers(F.col("salary"))
    out = []
    if f.location:
        out.append(F.contains(F.lower("location"), F.lit(f.location.lower())))
    if f.job_type:
        out.append(F.col("job_type") == f.job_type)
    if f.company:
        out.append(F.contains(F.lower("company"), F.lit(f.company.lower())))
    if f.min_salary is not None:
        out.append(F.array_max(amounts) >= f.min_salary)
    if f.max_salary is not None:
        out.append(F.array_min(amounts) <= f.max_salary)
    if f.date_posted:
        if as_of is None:
            raise ValueError("date_posted needs as_of")
        out.append(F.col("posted_at") >= as_of - F.make_dt_interval(F.lit(_DATE_DAYS[f.date_posted])))
    return out


def search(
    df: DataFrame,
    f: SearchFilter,
    limit: int = API_LIMIT,
    honour_all: bool = False,
    as_of: Column | None = None,
    ties: Sequence[str] = ("posting_id",),
) -> DataFrame:
    """Skills decide when given, else the newest postings; other fields on request."""
    if honour_all:
        for predicate in _extra_predicates(f, as_of):
            df = df.filter(predicate)
    if f.skills:
        return by_skills_substring(df, f.skills, limit, ties=ties)
    return recent_postings(df, limit, ties=ties)


def skill_vocabulary(
    df: DataFrame, limit: int = RECENT_LIMIT, ties: Sequence[str] = ("posting_id",)
) -> DataFrame:
    """Distinct skills of the newest postings, in code-point order."""
    newest = recent_postings(df.select("posted_at", *ties, "skills"), limit, ties=ties)
    return explode_once(newest, [], F.col("skills"), "skill").distinct().orderBy("skill")


def distinct_skills(df: DataFrame) -> DataFrame:
    """A4: every skill in use."""
    return explode_once(df, [], F.col("skills"), "skill").distinct()


def in_window(df: DataFrame, since: Column | datetime, until: Column | datetime, column: str = "created_at") -> DataFrame:
    """P5: rows saved in [since, until)."""
    at = F.col(column)
    return df.filter((at >= since) & (at < until))


#: Name of a total: aggregate and column. The aggregate must merge its own results, as `F.sum`, `F.min`, `F.max` do.
Totals = Mapping[str, tuple[Callable[[Column], Column], Column]]


def in_windows(
    rows: DataFrame,
    windows: DataFrame,
    column: str = "created_at",
    since: str = "since",
    until: str = "until",
    totals: Totals | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """P5/F6 for a table of windows: every pair of a row and a window [since, until) that holds it.

    With `totals`, in place of the pairs each window once for every value of `by` among its rows, and their totals.

    An interval join on time buckets: a window is dealt to the buckets, of the power of two next to its
    own length, that it touches - two at most, however long it is. A row looks into one bucket per length in
    use (a timestamp has no more than 63), so all joining is by equality. Both sides' columns are kept; windows
    that are empty or lack a bound hold nothing. Where one bucket holds much of the rows, adaptive execution
    splits it: the pair of length and bucket is an ordinary join key.
    """
    if totals is not None:
        return _totals_in_windows(rows, windows, totals, by, column, since, until)
    start, end, at = (F.unix_micros(c) for c in (since, until, column))
    bits = F.ceil(F.log2((end - start).cast("double"))).cast("int")
    sized = windows.filter(F.col(since) < F.col(until)).withColumn("_bits", bits)
    bucket = lambda micros, n: F.call_function("shiftright", micros, n)
    cells = F.sequence(bucket(start, F.col("_bits")), bucket(end - 1, F.col("_bits")))
    dealt = sized.withColumn("_cell", F.explode(cells))
    lengths = [r["_bits"] for r in sized.select("_bits").distinct().collect()]
    keyed = rows.withColumn("_bits", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")))
    keyed = keyed.withColumn("_cell", bucket(at, F.col("_bits")))
    inside = (F.col(column) >= F.col(since)) & (F.col(column) < F.col(until))
    return keyed.join(dealt, ["_bits", "_cell"]).filter(inside).drop("_bits", "_cell")


#: Instants are gathered in slots of 2**26 microseconds, about a minute, before they meet the windows.
SLOT_BITS = 26


def _totals_in_windows(
    rows: DataFrame,
    windows: DataFrame,
    totals: Totals,
    by: Sequence[str],
    column: str,
    since: str,
    until: str,
) -> DataFrame:
    """`in_windows` with totals in place of pairs.

    Rows that no bound of a window parts count as one. A window is a few whole cells, two at most of each
    power of two, and takes the totals of the cells; so work grows with rows and windows, however they overlap.
    """
    shift = lambda micros, n: F.call_function("shiftright", micros, n)
    by = list(by)
    merged = [fn(F.col(name)).alias(name) for name, (fn, _) in totals.items()]
    spans = windows.filter(F.col(since) < F.col(until)).select(since, until).distinct()
    ends = spans.select(F.unix_micros(since).alias("_a"), F.unix_micros(until).alias("_z"))
    bounds = ends.select(F.explode(F.array("_a", "_z")).alias("_at")).distinct().withColumn("_bound", F.col("_at"))

    # Totals of each instant, then of all instants since the last bound or the start of the slot.
    at = rows.select(F.unix_micros(column).alias("_at"), *by, *[c.alias(name) for name, (_, c) in totals.items()])
    instants = at.filter("_at IS NOT NULL").groupBy("_at", *by).agg(*merged)
    slot = shift(F.col("_at"), F.lit(SLOT_BITS))
    before = F.last("_bound", ignorenulls=True).over(Window.partitionBy("_slot").orderBy("_at"))
    placed = instants.unionByName(bounds, allowMissingColumns=True).withColumn("_slot", slot).withColumn("_from", before)
    start = F.coalesce("_from", F.call_function("shiftleft", F.col("_slot"), F.lit(SLOT_BITS)))
    met = placed.filter("_bound IS NULL").groupBy(start.alias("_at"), *by).agg(*merged)

    # The cells of 2**_bits microseconds that lie in a window, but whose halves are no larger such cell's.
    low = lambda n: -shift(-F.unix_micros(since), n)
    high = lambda n: shift(F.unix_micros(until), n)
    edges = lambda n: F.array(F.when(low(n) % 2 != 0, low(n)), F.when(high(n) % 2 != 0, high(n) - 1))
    cells = lambda n: F.transform(F.filter(edges(n), F.isnotnull), lambda c: F.struct(n.alias("_bits"), c.alias("_cell")))
    sizes = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda n: low(n) < high(n))
    cover = spans.select(since, until, F.inline(F.flatten(F.transform(sizes, cells))))
    used = [r["_bits"] for r in cover.select("_bits").distinct().collect()]
    sized = met.withColumn("_bits", F.explode(F.array(*map(F.lit, used)).cast("array<int>")))
    summed = sized.withColumn("_cell", shift(F.col("_at"), F.col("_bits"))).groupBy("_bits", "_cell", *by).agg(*merged)
    held = cover.join(summed, ["_bits", "_cell"]).groupBy(since, until, *by).agg(*merged)
    return windows.join(held, [since, until])


def recent_window(until: datetime, minutes: float = 60) -> tuple[datetime, datetime]:
    """P5: the window of the last minutes."""
    if not 0 < minutes < float("inf"):
        raise ValueError("minutes must be a positive number")
    return until - timedelta(minutes=minutes), until


def random_sample(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """T5: k rows in a reproducible random order."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k)
