"""Stored pages to raw postings (X1-X13): one Python pass per page, the rest expressions.

Each stage adds a few columns that the next one uses; a stage is one projection.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import html as H
from postmill.functions.dates import is_fresh, parse_posted
from postmill.functions.selectors import SELECTORS
from postmill.functions.text import (
    SPACE,
    collapse,
    company_bilingual,
    company_strip_prefix,
    description_cut,
    location_from_parts,
    location_strip_headcount,
    or_else,
)
from postmill.functions.urls import canonical_url
from postmill.operators.common import compute_once, explode_once, filter_here
from postmill.operators.dedup import dedup_urls

#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 4 << 20

Tables = Mapping[str, Mapping[str, Sequence[str]]]

# Texts that mark a page as blocked or missing.
BLOCKED_HTML = ("captcha", "verification required", "additional verification")
BLOCKED_TITLE = ("can't find", "not found", "verification required", "additional verification")
BLOCKED_GLASSDOOR = ("Job is OOO", "Access Denied")
BAD_TITLES = ("Get contacted", "Easy Apply")

# Selectors the rules below name themselves.
_MAIN = "main, article, [role='main']"
_CHROME = "nav, header, footer, script, style, [class*='nav'], [class*='header'], [class*='footer']"
_FOOTER = "div.jobsearch-JobMetadataFooter, div[class*='metadata'], footer"
_SKILLS_LABEL = "b:contains('Skills:')"
_JOB_LINK = "a[href*='/viewjob?jk='], a[href*='/rc/clk?jk=']"
_PLACE_LINK = "a[href*='/jobs/'][href*='-in-']"
_HEADER_COMPANY = "[data-testid='inlineHeader-companyName']"
_OWN = (
    "h1", "h2", "body", "a", _MAIN, _CHROME, _FOOTER, _SKILLS_LABEL, _JOB_LINK, _PLACE_LINK, "div.t-break",
    ".card-content", "meta[property='og:title']", "div[class*='location']", _HEADER_COMPANY,
)


def _has(text: Column, needles: Sequence[str]) -> Column:
    return F.greatest(*[F.contains(text, F.lit(n)) for n in needles], F.lit(False))


def is_blocked(html: Column, source: Column, title: Column | None = None) -> Column:
    """Verification, "not found" and access-denied pages, by the texts of the page's own board."""
    indeed = _has(F.lower(html), BLOCKED_HTML)
    if title is not None:
        indeed = indeed | _has(F.lower(title), BLOCKED_TITLE)
    blocked = F.when(source == "Indeed", indeed).when(source == "Glassdoor", _has(html, BLOCKED_GLASSDOOR))
    return F.coalesce(blocked, F.lit(False))


def drop_blocked(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("html").isNotNull() & ~is_blocked(F.col("html"), F.col("source")))


def valid_title(title: Column) -> Column:
    """X10."""
    return (F.length(title) >= 3) & ~_has(title, BAD_TITLES)


def _section_items(section: str) -> str:
    return f"{section} span, {section} li, {section} div"


def _keys(table: Mapping[str, Sequence[str]]) -> Iterable[str]:
    yield from _OWN
    for field, selectors in table.items():
        yield from selectors
        if field in ("jobCard", "url"):
            yield ", ".join(selectors)
        if field == "skillSections":
            yield from map(_section_items, selectors)


def with_page(pages: DataFrame, tables: Tables = SELECTORS) -> DataFrame:
    """Add the flattened page as column `page`; `source` decides which selectors are looked for.

    From now on batches of this session go to Python at `BATCH_BYTES` at most, a larger page alone.
    """
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return pages.withColumn("page", H.page_udf({n: _keys(t) for n, t in tables.items()})(F.col("html"), F.col("source")))


PAGE = "page"


def _per_source(values: Mapping[str, Column], default: Column) -> Column:
    out = default
    for name, value in values.items():
        out = F.when(F.col("source") == name, value).otherwise(out)
    return out


def _selectors(tables: Tables, field: str, also: Mapping[str, Sequence[str]] | None = None) -> str:
    """The selectors each board uses for a field, looked up by `source`."""
    return _by_source({n: [*t.get(field, ()), *(also or {}).get(n, ())] for n, t in tables.items()})


def _by_source(lists: Mapping[str, Sequence[str]]) -> str:
    # One literal, folded once, instead of a branch per board.
    table = f"from_json({H.lit(json.dumps(lists, ensure_ascii=False))}, 'map<string,array<string>>')"
    return f"coalesce(try_element_at({table}, source), {H.lits(())})"


def company_from_links(pattern: str, min_len: int = 1, refuse: Sequence[str] = ()) -> Column:
    """X11: text of the first link to a company page; null when there is none."""
    links = H.kept(f"{PAGE}.els", lambda e: f"({e}.tag = 'a' AND coalesce({e}.href RLIKE {H.lit(pattern)}, false))")
    named = H.mapped(links, lambda a: H.trimmed(H.text_of(PAGE, f"{a}.idx")))
    refused = H.lits(["", *refuse])
    good = lambda t: f"(length({t}) BETWEEN {min_len} AND 99 AND NOT array_contains({refused}, {t}) AND NOT contains({t}, '{{'))"
    return F.expr(f"get({H.kept(named, good)}, 0)")


def skill_tags(table: Mapping[str, Sequence[str]]) -> str:
    """Texts of tag elements and of short items in skill sections, as written."""

    def short(selectors: Sequence[str], low: int) -> str:
        found = f"flatten({H.mapped(H.lits(selectors), lambda s: H.hits(PAGE, s))})"
        return H.kept(H.texts_of(PAGE, found), lambda t: f"length({t}) BETWEEN {low} AND 29")

    items = [_section_items(s) for s in table["skillSections"]]
    return f"concat({short(table['detailSkills'], 1)}, {short(items, 3)})"


def date_text_from_page() -> str:
    """The first relative date the page's text names, posting lines before others."""
    unit = rf"[0-9]+\+?{SPACE}*(?:day|hour|week)s?{SPACE}*ago"
    patterns = [
        rf"(?i)(?:Posted|Active){SPACE}+{unit}",
        rf"(?i)(?:Posted|Active){SPACE}+(?:today|just posted)",
        rf"(?i){unit}",
        r"(?i)today|just posted",
    ]
    found = lambda text, p: f"regexp_extract({text}, {H.lit(p)}, 0)"
    footer = found(H.joined_text(PAGE, H.lit(_FOOTER)), rf"(?i){unit}|today|just posted")
    return H.either(*[found(f"{PAGE}.text", p) for p in patterns], footer)


def _noise(title: Column) -> Column:
    return (title == "") | F.contains(title, F.lit("Get contacted"))


def _with_title(df: DataFrame, tables: Tables) -> DataFrame:
    more = {
        "Wuzzuf": ["h1"],
        "Glassdoor": tables.get("Glassdoor", {}).get("otherTitle", ()),
    }
    h1 = H.first_text(PAGE, H.lits(["h1"]))
    own = H.either(H.first_own_text(PAGE, _selectors(tables, "detailTitle")), h1)
    meta = H.first_attr(PAGE, H.lits(["meta[property='og:title']"]), "content")
    noise = lambda t: f"NOT ({t} = '' OR contains({t}, 'Get contacted'))"
    bayt = H.kept(f"array({h1}, {H.first_text(PAGE, _selectors(tables, 'titleText'))})", noise)
    title = f"""CASE source WHEN 'Indeed' THEN {own} WHEN 'Bayt' THEN coalesce(get({bayt}, 0), {meta}, '')
      ELSE {H.first_text(PAGE, _selectors(tables, "detailTitle", more))} END"""
    return df.withColumn("title", F.expr(title))


def _titled(row: Column) -> Column:
    """Whether a page is a posting at all."""
    blocked = (row["source"] == "Indeed") & _has(F.lower(row["title"]), BLOCKED_TITLE)
    nameless = (row["source"] == "Bayt") & ~valid_title(row["title"])
    return (row["title"] != "") & ~blocked & ~nameless


def _with_company(df: DataFrame, tables: Tables) -> DataFrame:
    source = F.col("source")
    listed = f"""CASE source WHEN 'Indeed' THEN {H.first_own_text(PAGE, _selectors(tables, "detailCompany"))}
      WHEN 'Bayt' THEN {H.first_text(PAGE, _selectors(tables, "companyText"))}
      ELSE {H.first_text(PAGE, _selectors(tables, "detailCompany"))} END"""
    listed = F.expr(listed)
    linked = F.when(source == "Indeed", company_from_links("/cmp/")).when(
        source == "Bayt", company_from_links(r"/company/.+-[0-9]+/$", 3, ("Companies", "See company details"))
    )
    header = f"get({H.hits(PAGE, H.lit(_HEADER_COMPANY))}, 0)"
    tested = F.expr(f"CASE WHEN source = 'Indeed' THEN {H.trimmed(H.own_text_of(PAGE, header))} END")
    found = df.withColumns({"_listed": listed, "_linked": linked, "_tested": tested})
    name = F.col("_listed")
    indeed = or_else(name, F.col("_linked"), F.col("_tested"))
    bayt = F.when(_noise(name) | (name == "Companies"), F.coalesce("_linked", name)).otherwise(name)
    chosen = found.withColumn(
        "_name", F.when(source == "Indeed", indeed).when(source == "Bayt", company_bilingual(bayt)).otherwise(name)
    )
    name = F.col("_name")
    debris = _has(name, ["{", ".css-"]) | name.isin("", "Company Name Not Listed")
    company = (
        F.when(source == "LinkedIn", or_else(name, F.lit("N/A")))
        .when(source == "Wuzzuf", or_else(name, F.lit("Wuzzuf Company")))
        .when(source == "Glassdoor", or_else(name, F.lit("Unknown Company")))
        .when(source == "Indeed", company_strip_prefix(F.when(debris, "Indeed").otherwise(name)))
        .when(source == "Bayt", F.when(name.isin("", "N/A", "Companies"), "Bayt.com").otherwise(name))
    )
    return chosen.withColumn("company", company).drop("_listed", "_linked", "_tested", "_name")


def _with_location(df: DataFrame, tables: Tables) -> DataFrame:
    source = F.col("source")
    own = H.either(
        H.first_own_text(PAGE, _selectors(tables, "detailLocation")), H.first_text(PAGE, H.lits(["div[class*='location']"]))
    )
    parts = F.expr(H.all_texts(PAGE, _selectors(tables, "location")))
    links = F.expr(H.texts_of(PAGE, H.hits(PAGE, H.lit(_PLACE_LINK))))
    listed = f"CASE WHEN source = 'Indeed' THEN {own} ELSE {H.first_text(PAGE, _selectors(tables, 'detailLocation'))} END"
    found = F.when(source == "Bayt", location_from_parts(parts, links)).otherwise(F.expr(listed))
    name = F.col("_found")
    location = (
        F.when(source == "Wuzzuf", location_strip_headcount(or_else(name, F.lit("Egypt"))))
        .when(source == "Glassdoor", or_else(name, F.lit("Not Specified")))
        .when(source == "Indeed", F.when(name.isin("", "Location Not Specified"), "Remote").otherwise(name))
        .otherwise(name)
    )
    return df.withColumn("_found", found).withColumn("location", location).drop("_found")


# A description shorter than this makes a board's rules look further.
_FLOORS = {"Wuzzuf": 100, "Bayt": 100, "Indeed": 200, "Glassdoor": 200}


def _with_description(df: DataFrame, tables: Tables) -> DataFrame:
    source, text = F.col("source"), F.col("_text")
    short = F.length(text) < _per_source({n: F.lit(v) for n, v in _FLOORS.items()}, F.lit(0))
    preferred = _selectors(tables, "detailDescription")
    long_enough = f"get({H.kept(H.mapped(preferred, lambda s: H.joined_text(PAGE, s)), lambda t: f'length({t}) > 200')}, 0)"
    # Bayt: the block right after the heading that announces the description.
    headings = H.mapped(H.hits(PAGE, "'h2'"), lambda i: H.element(PAGE, i))
    heads = H.kept(headings, lambda h: f"lower({H.text_of(PAGE, f'{h}.idx')}) RLIKE 'job description|responsibilities'")
    after = lambda i, h: f"({i} = {h}.last + 1 AND {H.element(PAGE, i)}.parent = {h}.parent)"
    announced = H.kept(H.hits(PAGE, "'div.t-break'"), lambda i: f"exists({heads}, {H.fn(lambda h: after(i, h))})")
    start = f"""CASE WHEN source IN ('Indeed', 'Glassdoor') THEN coalesce({long_enough}, '')
      WHEN source = 'Bayt' THEN coalesce({H.trimmed(H.text_of(PAGE, f"get({announced}, 0)"))}, '')
      ELSE {H.first_text(PAGE, preferred)} END"""
    start = F.expr(start)
    broken = H.first_text(PAGE, H.lits(["div.t-break"]))
    longest = H.longest_text(PAGE, "_text", _selectors(tables, "containers"))
    other = f"CASE WHEN source = 'Bayt' THEN {H.either(broken, '_text')} ELSE {longest} END"
    second = F.when(short, F.expr(other)).otherwise(text)
    card = F.expr(H.joined_text(PAGE, "'.card-content'"))
    page_text = H.either(H.joined_text(PAGE, H.lit(_MAIN)), H.joined_text(PAGE, "'body'"))
    third = F.when(
        short,
        F.when(source == "Wuzzuf", F.expr(page_text))
        .when(source == "Glassdoor", F.expr(H.text_without(PAGE, "'body'", H.lit(_CHROME))))
        .when((source == "Bayt") & (F.length(card) > 200), description_cut(card, True))
        .otherwise(text),
    ).otherwise(text)
    flat = (
        F.when(source.isin("Indeed", "Glassdoor"), F.btrim(collapse(text)))
        .when(source == "Bayt", description_cut(text))
        .otherwise(text)
    )
    position = F.concat(F.col("title"), F.lit(" position at "), F.col("company"))
    final = (
        F.when((source == "Wuzzuf") & (text == ""), position)
        .when(source.isin("Indeed", "Glassdoor") & (F.length(text) < 50), F.concat(position, F.lit(". Tech job opportunity.")))
        .when(
            (source == "Bayt") & (F.length(text) < 50),
            F.concat(position, F.lit(" in "), F.col("location"), F.lit(". Join our team!")),
        )
        .otherwise(text)
    )
    for step in (start, second, third, flat):
        df = df.withColumn("_text", step)
    return df.withColumn("description", final).drop("_text")


def _with_rest(df: DataFrame, tables: Tables) -> DataFrame:
    guesses = H.kept(
        H.mapped(_selectors(tables, "otherDate"), lambda s: H.first_text(PAGE, f"array({s})")),
        lambda t: f"(contains({t}, 'ago') OR contains({t}, 'Posted'))",
    )
    listed = H.either(H.first_text(PAGE, _selectors(tables, "detailDate")), f"get({guesses}, 0)")
    date_text = F.expr(f"CASE source WHEN 'Indeed' THEN {date_text_from_page()} WHEN 'Bayt' THEN '' ELSE {listed} END")
    salary = f"""CASE source WHEN 'Indeed' THEN {H.first_own_text(PAGE, _selectors(tables, "detailSalary"))}
      WHEN 'Bayt' THEN {H.first_text(PAGE, _selectors(tables, "salary"))}
      ELSE {H.first_text(PAGE, _selectors(tables, "detailSalary"))} END"""
    salary = F.expr(salary)
    tags = f"CASE WHEN source = 'Wuzzuf' THEN {skill_tags(tables['Wuzzuf'])} END" if "Wuzzuf" in tables else "NULL"
    return df.withColumns(
        {
            "date_text": date_text,
            "salary": salary,
            "page_tags": F.expr(f"coalesce({tags}, {H.lits(())})"),
        }
    ).withColumn("salary", F.when(F.col("salary").rlike("[0-9]"), F.col("salary")))


def detail_fields(pages: DataFrame, tables: Tables = SELECTORS) -> DataFrame:
    """Fields of detail pages (page_id, source, url, html); pages without a title are gone."""
    return filter_here(_all_fields(pages, tables), _titled)


def _all_fields(pages: DataFrame, tables: Tables) -> DataFrame:
    df = with_page(drop_blocked(pages), tables).drop("html")
    for stage in (_with_title, _with_company, _with_location, _with_description, _with_rest):
        df = stage(df, tables)
    return df.drop("page")


def detail_to_raw(pages: DataFrame, as_of: Column, tables: Tables = SELECTORS) -> DataFrame:
    """X7 with dates: detail pages to raw postings.

    `pages` may carry `listing_date`, the date text of the listing, which then counts
    instead of the page's own. Rows whose board drops undated postings are gone; a board
    whose pages carry no date of their own (Bayt) falls back to the run's time.
    """
    listing = F.col("listing_date") if "listing_date" in pages.columns else F.lit(None).cast("string")
    fields = _all_fields(pages.withColumn("listing_date", listing), tables)
    undated = (F.col("source") == "Bayt") & F.col("listing_date").isNull()
    text = F.coalesce("listing_date", "date_text")
    posted = F.when(undated, as_of).otherwise(parse_posted(text, F.col("source"), as_of))
    dated = fields.withColumn("posted_at", posted).withColumnRenamed("page_id", "arrival").drop("listing_date")
    return filter_here(dated, lambda row: _titled(row) & row["posted_at"].isNotNull())


def listing_to_links(pages: DataFrame, as_of: Column, tables: Tables = SELECTORS) -> DataFrame:
    """Listing pages with a `source` column to distinct (source, url, page_id, date_text) links.

    Links whose listing date is already too old for their board are dropped here, before
    any detail page is read.
    """
    source = F.col("source")
    groups = {
        n: [", ".join(t["jobCard"])] if "jobCard" in t else list(t.get("jobCards", ())) for n, t in tables.items()
    }
    # The first selector that matches anything; boards with a union of selectors have one group.
    lists = H.mapped(_by_source(groups), lambda s: H.hits(PAGE, s))
    cards = f"get({H.kept(lists, lambda a: f'size({a}) > 0')}, 0)"
    urls = {n: list(t["url"]) for n, t in tables.items()}
    for name in ("LinkedIn", "Wuzzuf"):
        if name in urls:
            urls[name] = [", ".join(urls[name])]
    urls = {n: v + {"Glassdoor": ["a"], "Indeed": [_JOB_LINK]}.get(n, []) for n, v in urls.items()}
    dates = {"Wuzzuf": "cardDate", "Bayt": "datePosted", "Glassdoor": "cardAge"}

    ready = with_page(drop_blocked(pages), tables).select(
        "page_id",
        "source",
        "page",
        F.expr(_by_source(urls)).alias("_urls"),
        F.expr(_by_source({n: tables[n][f] for n, f in dates.items() if n in tables})).alias("_dates"),
        F.expr(cards).alias("_cards"),
    )

    def link(card: str) -> str:
        found = H.mapped("_dates", lambda s: H.first_text(PAGE, f"array({s})", card))
        told = lambda t: f"CASE WHEN source = 'Wuzzuf' THEN contains({t}, 'ago') OR contains({t}, 'منذ') ELSE {t} <> '' END"
        date = f"coalesce(get({H.kept(found, told)}, 0), '')"
        return f"named_struct('link', {H.first_attr(PAGE, '_urls', 'href', card)}, 'date_text', {date})"

    links = F.expr(H.mapped("_cards", lambda i: H.bound(H.element(PAGE, i), link)))
    rows = (
        explode_once(ready, ["page_id", "source"], links, "card")
        .filter(F.col("card.link").isNotNull())
        .select("page_id", "source", canonical_url(F.col("card.link"), source).alias("url"), "card.date_text")
    )
    # Only dates a text really names count against a link here; the rest waits for the detail page.
    named = F.when(F.col("date_text") != "", parse_posted(F.col("date_text"), source, as_of))
    dated = compute_once(rows.withColumn("_posted", named), "_posted")
    young = is_fresh(F.col("_posted"), source, as_of) | (F.col("_posted").isNull() & (source != "Bayt"))
    return (
        dated.filter(F.col("url").isNotNull() & young)
        .groupBy("source", "url")
        .agg(F.min(F.struct("page_id", "date_text")).alias("first"))
        .select("source", "url", "first.page_id", "first.date_text")
    )


def listing_to_postings(pages: DataFrame, as_of: Column, tables: Tables = SELECTORS) -> DataFrame:
    """Whole raw postings from the cards of the board that prints them in its listing (Glassdoor)."""
    table, source = tables["Glassdoor"], F.lit("Glassdoor")

    def one(card: str) -> str:
        text = lambda field: H.first_text(PAGE, H.lits(table[field]), card)
        label = H.element(PAGE, f"get({H.within(H.hits(PAGE, H.lit(_SKILLS_LABEL)), card)}, 0)")
        line = f"regexp_replace({H.text_of(PAGE, f'{label}.parent')}, {H.lit('^(?s)(.*?)Skills:')}, '$1')"
        fields = {
            "link": H.first_attr(PAGE, H.lits([*table["url"], "a"]), "href", card),
            "title": H.either(text("cardTitle"), "'Unknown Title'"),
            "company": H.either(text("cardCompany"), "'Unknown Company'"),
            "location": H.either(text("cardLocation"), "'Not Specified'"),
            "salary": text("cardSalary"),
            "snippet": text("cardSnippet"),
            "skills_line": f"coalesce({H.trimmed(line)}, '')",
            "date_text": text("cardAge"),
        }
        return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"

    listings = pages.withColumn("source", source)
    found = F.expr(H.mapped(H.hits(PAGE, H.lit(", ".join(table["jobCard"]))), lambda i: H.bound(H.element(PAGE, i), one)))
    rows = with_page(drop_blocked(listings), {"Glassdoor": table}).select("page_id", F.posexplode(found).alias("pos", "c"))
    required = F.when(
        F.col("c.skills_line") != "", F.concat(F.lit("\n\nRequired Skills: "), F.col("c.skills_line"))
    ).otherwise("")
    synthetic = F.concat(F.col("c.title"), F.lit(" position at "), F.col("c.company"), F.lit(". Tech job opportunity."))
    return (
        rows.filter(F.col("c.link").isNotNull())
        .select(
            F.struct("page_id", "pos").alias("arrival"),
            source.alias("source"),
            canonical_url(F.col("c.link"), source).alias("url"),
            "c.title",
            "c.company",
            "c.location",
            or_else(F.concat(F.col("c.snippet"), required), synthetic).alias("description"),
            F.when(F.col("c.salary").rlike("[0-9]"), F.col("c.salary")).alias("salary"),
            "c.skills_line",
            parse_posted(F.col("c.date_text"), source, as_of).alias("posted_at"),
        )
        .filter(is_fresh(F.col("posted_at"), source, as_of))
    )


def detail_or_listing(
    listing: DataFrame, detail: DataFrame, fields: Sequence[str], order: str | None = None
) -> DataFrame:
    """The detail row's fields where a detail row exists, else the listing row's.

    Of several detail rows of a url the lowest in `order` (unique) counts; without one, the
    least by the fields.
    """
    if order is None:
        one = detail.groupBy("url").agg(F.min(F.struct(*fields)).alias("_least")).select("url", "_least.*")
    else:
        one = dedup_urls(detail, order=order)
    found = one.select("url", F.lit(True).alias("_found"), *[F.col(f).alias(f"_d_{f}") for f in fields])
    joined = listing.join(found, "url", "left")
    pick = {f: F.when(F.col("_found"), F.col(f"_d_{f}")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(pick).withColumn("from_detail", F.coalesce("_found", F.lit(False))).drop(
        "_found", *[f"_d_{f}" for f in fields]
    )
