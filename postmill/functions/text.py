"""Text normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as web pages use it; Java's \\s and Spark's trim know only part of it.
SPACES = (
    " \t\n\r\f\x0b\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE = "[\\s\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"

# Edges of an ASCII word. Java's \b counts letters such as "é" as word characters, these do not.
WORD_START = "(?<![A-Za-z0-9_])"
WORD_END = "(?![A-Za-z0-9_])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it many times inside `body`."""
    return F.get(F.transform(F.array(value), body), 0)


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.btrim(text, F.lit(SPACES))


def or_else(text: Column, *others: Column) -> Column:
    """First value that is neither null nor empty; empty text if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (text, *others)], F.lit(""))


def clean_text(text: Column) -> Column:
    """One-line text without ellipses; the first "new" glued to a number is dropped."""
    flat = F.replace(collapse(text), F.lit("…"), F.lit(""))
    # The edge is checked after the letters: a look-behind at every position would be slow.
    glued = "(?i)new(?<![A-Za-z0-9_]new)(?=[0-9])"
    first_new = lambda t: F.when(
        t.rlike(glued), F.regexp_replace(t, f"(?is)^(.*?){WORD_START}new(?=[0-9])", "$1")
    ).otherwise(t)
    return F.btrim(let(flat, first_new))


def normalize_for_match(text: Column, unicode: bool = False) -> Column:
    """Lower-case words separated by single blanks.

    By default only ASCII word characters count, so text in other scripts normalises to
    nothing; `unicode=True` keeps letters and digits of every script.
    """
    other = r"[^\p{L}\p{N}_]+" if unicode else r"\W+"
    return F.btrim(F.regexp_replace(F.lower(text), other, " "))


def signature(title: Column, company: Column, unicode: bool = False) -> Column:
    """Identity of a posting across boards - three telling title words and the company."""
    words = F.filter(F.split(normalize_for_match(title, unicode), " "), lambda w: F.length(w) > 2)
    return F.concat(F.array_join(F.slice(words, 1, 3), " "), F.lit("::"), normalize_for_match(company, unicode))


def salary_if_numeric(salary: Column) -> Column:
    """A salary text is kept only if it names a number."""
    return F.when(salary.rlike("[0-9]"), clean_text(salary))


def company_bilingual(company: Column) -> Column:
    """Of "local name / English name" keep the second part, else the first."""
    parts = F.split(company, "/")
    part = lambda i: F.nullif(trim_all(F.get(parts, F.lit(i))), F.lit(""))
    return F.when(F.contains(company, F.lit("/")), F.coalesce(part(1), part(0), company)).otherwise(trim_all(company))


def company_strip_prefix(company: Column) -> Column:
    """Drop a leading "Work at ", then a leading "Review for "."""
    return F.regexp_replace(F.regexp_replace(company, "^Work at ", ""), "^Review for ", "")


def location_strip_headcount(location: Column) -> Column:
    """Drop company sizes such as "· 51-200 Employees" from a location."""
    size = f"[0-9]+[-+]?[0-9]*{SPACE}*employees?"
    bare = F.regexp_replace(F.regexp_replace(location, f"(?i)[·•]{SPACE}*{size}", ""), f"(?i){size}", "")
    return F.btrim(collapse(bare))


def location_from_parts(parts: Column, links: Column | None = None) -> Column:
    """Location from its text parts; the first two location links win when present."""
    wanted = F.filter(
        parts,
        lambda p: (F.length(p) > 1)
        & (F.length(p) < 50)
        & (p != "·")
        & ~F.lower(p).rlike(r"ago|apply|easy|today|yesterday|[0-9]{4}/[0-9]{2}/[0-9]{2}"),
    )
    text = F.array_join(wanted, ", ")
    if links is not None:
        named = F.filter(links, lambda p: (F.length(p) > 2) & (F.length(p) < 50) & ~F.contains(p, F.lit("jobs")))
        text = or_else(F.array_join(F.slice(named, 1, 2), ", "), text)
    return F.when(F.length(text) < 2, F.lit("Remote")).otherwise(text)


def description_cut(text: Column, last_resort: bool = False) -> Column:
    """Cut a description where the page's call-to-action text begins."""
    markers = ["Get contacted by recruiters", "Easy Apply"] + (["Email to Friend"] if last_resort else [])
    return F.btrim(F.regexp_replace(collapse(text), f"(?is)(?:{'|'.join(markers)}).*$", ""))
