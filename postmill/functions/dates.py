"""Relative dates of the boards (D1-D8). `as_of` is always an argument, never the clock."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import SPACE, let, trim_all

MINUTE = 60 * 1_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
WEEK = 7 * DAY
MONTH = 30 * DAY

# The first of January of the year 1: a count that reaches behind it names no date.
EARLIEST = -62_135_596_800_000_000


@dataclass(frozen=True)
class DatePolicy:
    """What a board does with a text that names no date, and how old a posting may be."""

    on_null: str  # now | drop | minus_3d
    max_age_days: int
    future_ok: bool = True


# Policy per board.
POLICIES = {
    "LinkedIn": DatePolicy("now", 7),
    "Wuzzuf": DatePolicy("drop", 14),
    "Bayt": DatePolicy("drop", 7, future_ok=False),
    "Indeed": DatePolicy("minus_3d", 7),
    "Glassdoor": DatePolicy("now", 7),
}


def _back(as_of: Column, micros: Column | int) -> Column:
    then = F.try_subtract(F.unix_micros(as_of), F.lit(micros))
    return F.when(then >= EARLIEST, F.timestamp_micros(then))


def _count(text: Column, regex: str, group: int = 1) -> Column:
    """The number a regex captures, null when it does not match or has more digits than a bigint."""
    return F.regexp_extract(text, regex, group).try_cast("bigint")


def _ago(text: Column, as_of: Column, regex: str, unit: int) -> Column:
    """`as_of` minus the count the regex captures, null when it does not match."""
    return _back(as_of, F.try_multiply(_count(text, regex), F.lit(unit)))


def _unit_ago(text: Column, as_of: Column, regex: str, units: dict[str, int]) -> Column:
    """As `_ago`, the second group of the regex naming the unit."""
    name = F.regexp_extract(text, regex, 2)
    micros = F.coalesce(*[F.when(name == word, F.lit(size).cast("bigint")) for word, size in units.items()])
    return _back(as_of, F.try_multiply(_count(text, regex), micros))


def _months_ago(text: Column, as_of: Column, regex: str) -> Column:
    """Calendar months back; a day the target month lacks runs over into the next month."""
    start = F.date_trunc("month", as_of)
    count = _count(text, regex)
    months = F.when(count < 12 * F.year(as_of) - 12, count).try_cast("int")
    target = F.add_months(start.cast("date"), -months).cast("timestamp")
    return F.timestamp_micros(F.unix_micros(target) + F.unix_micros(as_of) - F.unix_micros(start))


def _iso(text: Column) -> Column:
    """Absolute ISO dates; other free text is not guessed at."""
    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
    return F.when(text.rlike(iso), text.try_cast("timestamp"))


S = f"{SPACE}*"


def _contains(text: Column, *needles: str) -> Column:
    return F.greatest(*[F.contains(text, F.lit(n)) for n in needles], F.lit(False))


def parse_linkedin(text: Column, as_of: Column) -> Column:
    """N minute/hour/day/week, English then French, then ISO; months are not known."""
    english = {"minute": MINUTE, "hour": HOUR, "day": DAY, "week": WEEK}
    french = {"minute": MINUTE, "heure": HOUR, "jour": DAY, "semaine": WEEK}
    return let(
        F.lower(trim_all(text)),
        lambda t: F.coalesce(
            _unit_ago(t, as_of, f"([0-9]+){S}(minute|hour|day|week)", english),
            _unit_ago(t, as_of, f"il y a ([0-9]+){S}(minute|heure|jour|semaine)", french),
            _iso(trim_all(text)),
        ),
    )


def parse_wuzzuf(text: Column, as_of: Column) -> Column:
    """English phrases, Arabic phrases, ISO. A month is 30 days."""
    return let(
        F.lower(trim_all(text)),
        lambda t: F.coalesce(
            F.when(_contains(t, "today"), as_of),
            F.when(_contains(t, "yesterday"), _back(as_of, DAY)),
            _ago(t, as_of, f"([0-9]+){S}hours?{S}ago", HOUR),
            _ago(t, as_of, f"([0-9]+){S}days?{S}ago", DAY),
            _ago(t, as_of, f"([0-9]+){S}weeks?{S}ago", WEEK),
            _ago(t, as_of, f"([0-9]+){S}months?{S}ago", MONTH),
            F.when(_contains(t, "اليوم"), as_of),
            F.when(_contains(t, "أمس"), _back(as_of, DAY)),
            _ago(t, as_of, f"منذ{S}([0-9]+){S}(?:يوم|أيام)", DAY),
            _ago(t, as_of, f"منذ{S}([0-9]+){S}(?:أسبوع|أسابيع)", WEEK),
            _ago(t, as_of, f"منذ{S}([0-9]+){S}(?:شهر|أشهر)", MONTH),
            _iso(trim_all(text)),
        ),
    )


def parse_bayt(text: Column, as_of: Column) -> Column:
    """D3: English phrases with calendar months; absolute dates are not read."""
    return let(
        F.lower(trim_all(text)),
        lambda t: F.coalesce(
            F.when(_contains(t, "yesterday"), _back(as_of, DAY)),
            F.when(_contains(t, "today", "just posted"), as_of),
            _ago(t, as_of, f"([0-9]+){S}days?{S}ago", DAY),
            _ago(t, as_of, f"([0-9]+){S}hours?{S}ago", HOUR),
            _ago(t, as_of, f"([0-9]+){S}weeks?{S}ago", WEEK),
            _months_ago(t, as_of, f"([0-9]+){S}months?{S}ago"),
        ),
    )


def parse_indeed(text: Column, as_of: Column) -> Column:
    """English phrases including "30+ days ago", ISO; texts of 50 characters and more are no dates."""
    return F.when(
        F.length(text) < 50,
        let(
            F.lower(trim_all(text)),
            lambda t: F.coalesce(
                F.when(_contains(t, "just posted", "today"), as_of),
                _ago(t, as_of, f"([0-9]+){S}hours?{S}ago", HOUR),
                _ago(t, as_of, f"([0-9]+){S}days?{S}ago", DAY),
                _ago(t, as_of, f"([0-9]+)\\+{S}days?{S}ago", DAY),
                _ago(t, as_of, f"([0-9]+){S}weeks?{S}ago", WEEK),
                _iso(trim_all(text)),
            ),
        ),
    )


def parse_glassdoor(text: Column, as_of: Column) -> Column:
    """Short forms (24h, 2d, 3w, 1m, 30d+) and phrases, then ISO. A month is 30 days."""
    short = lambda t, letter, word, unit: F.coalesce(
        _ago(t, as_of, f"^([0-9]+){letter}$", unit), _ago(t, as_of, f"([0-9]+){S}{word}s?{S}ago", unit)
    )
    return let(
        F.lower(trim_all(text)),
        lambda t: F.coalesce(
            F.when(_contains(t, "today", "just posted"), as_of),
            F.when(_contains(t, "yesterday"), _back(as_of, DAY)),
            short(t, "h", "hour", HOUR),
            short(t, "d", "day", DAY),
            short(t, "w", "week", WEEK),
            short(t, "m", "month", MONTH),
            _ago(t, as_of, r"^([0-9]+)d\+$", DAY),
            _ago(t, as_of, f"([0-9]+)\\+{S}days?{S}ago", DAY),
            _iso(trim_all(text)),
        ),
    )


PARSERS = {
    "LinkedIn": parse_linkedin,
    "Wuzzuf": parse_wuzzuf,
    "Bayt": parse_bayt,
    "Indeed": parse_indeed,
    "Glassdoor": parse_glassdoor,
}


def with_policy(parsed: Column, source: str, as_of: Column) -> Column:
    """A board's answer to a text without a date: now, three days ago, or null (row dropped)."""
    fallback = {"now": as_of, "minus_3d": _back(as_of, 3 * DAY), "drop": F.lit(None).cast("timestamp")}
    return F.coalesce(parsed, fallback[POLICIES[source].on_null])


def parse_posted(text: Column, source: Column, as_of: Column) -> Column:
    """Dispatch by board, policy included. Null means the row is to be dropped."""
    out = F.lit(None).cast("timestamp")
    for name, parser in PARSERS.items():
        out = F.when(source == name, with_policy(parser(text, as_of), name, as_of)).otherwise(out)
    return out


def age_days(posted: Column, as_of: Column) -> Column:
    """Age in fractional days."""
    return (F.unix_micros(as_of) - F.unix_micros(posted)) / F.lit(float(DAY))


def is_fresh(posted: Column, source: Column, as_of: Column) -> Column:
    """Young enough for its board; false for null dates and unknown boards."""
    days = F.lit(None).cast("bigint")
    for name, policy in POLICIES.items():
        days = F.when(source == name, F.lit(policy.max_age_days).cast("bigint")).otherwise(days)
    strict = source.isin([name for name, policy in POLICIES.items() if not policy.future_ok])
    young = F.unix_micros(posted) >= F.unix_micros(as_of) - days * DAY
    return F.coalesce(young & (~strict | (posted <= as_of)), F.lit(False))
