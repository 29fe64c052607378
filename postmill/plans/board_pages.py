"""Detail and listing pages of the five boards, written from the posting view.

Each posting of the view becomes a page in its board's markup, with the variants that the extraction rules
tell apart (missing companies, debris, second-choice elements, calls to action), so that every field an
extraction must find is known from the tables. `TEXTS` is what a browser would show, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.common import compute_once
from postmill.plans import posting_view as P

#: Which postings get the second variant of their board's page.
ODD = "floor(posting_no / 5) % 2 = 1"

# Markup by board: (variant, markup before, field or text, markup after); variant None is in both.
# A field in braces is a column of the view, escaped; other text stands as it is.
PARTS: dict[str, tuple[tuple[bool | None, str, str, str], ...]] = {
    "LinkedIn": (
        (None, '<nav><a href="/jobs">', "Jobs", "</a></nav>"),
        (False, '<h2 class="top-card-layout__title"> ', "{title}", " </h2>"),
        (True, '<h1 class="jobs-unified-top-card__job-title">', "{title}", "</h1>"),
        (None, '<h4 class="top-card-layout__second-subline"><a href="/c">', "{company}", "</a>"),
        (None, "", " {location}", "</h4>"),
        (False, '<div class="description__text"><p>', "{description}", "</p></div>"),
        (True, '<section id="job-details">', "{description}", "</section>"),
        (None, '<span class="posted-time-ago__text">', "{date_text}", "</span>"),
    ),
    "Indeed": (
        (None, "<style>.css-1{color:red}</style><h1 class='jobsearch-JobInfoHeader-title'>", "{title}", ""),
        (None, "<span>", " - job post", "</span></h1>"),
        (False, "<div data-company-name='true'>", "{company}", "</div>"),
        (True, "<div data-company-name='true'><span>", ".css-9ab", "</span></div>"),
        (True, '<a href="/cmp/x">', "Review for {company}", "</a>"),
        (None, '<div data-testid="job-location">', "{location}", "</div>"),
        (None, '<div id="jobDescriptionText">', "{description}", "</div>"),
        (None, '<div class="salary-snippet">', "{salary}", "</div><script>var posted = '1 day ago';</script>"),
        (None, "<footer>", "Posted {date_text}", "</footer>"),
    ),
    "Glassdoor": (
        (None, "<nav>", "Menu", "</nav>"),
        (False, '<h1 class="job-title">', "{title}", "</h1>"),
        (True, '<p class="css-1vg6q84">', "{title}", "</p>"),
        (False, '<div data-test="employer-name">', "{company}", "</div>"),
        (None, '<div data-test="location">', "{location}", "</div>"),
        (None, '<div class="job-description">', "{description}", "</div>"),
        (None, '<div data-test="salary">', "{salary}", "</div>"),
        (False, '<div data-test="post-date">', "{date_text}", "</div>"),
        (True, '<b class="xposted">', "Posted {date_text}", "</b>"),
        (None, "<footer>", "Legal", "</footer>"),
    ),
    "Wuzzuf": (
        (None, "<nav>", "Menu", "</nav><h1>"),
        (None, "", "{title}", "</h1>"),
        (False, '<div class="css-d7j1kk"><a href="/c">', "{company}", "</a></div>"),
        (None, '<span class="job-location">', "{location} · 51-200 Employees", "</span>"),
        (False, '<div class="job-requirements">', "{description}", "</div>"),
        (True, '<div class="job-requirements">', "See below.", "</div>"),
        (True, "<main>", "{description}", "</main>"),
        (None, '<span class="job-posted-date">', "posted {date_text}", "</span>"),
        (None, '<span class="salary">', "{salary}", "</span>"),
        (None, '<div class="skills"><ul><li>', "Team work", "<li>"),
        (None, "", "Excel", "<li>"),
        (None, "", "x", "</ul></div>"),
        (None, '<p class="skill-tag">', "{feed}", "</p>"),
    ),
    "Bayt": (
        (False, "<h1>", "{title}", "</h1>"),
        (True, "<h1>", "Get contacted by recruiters", "</h1>"),
        (True, '<h2><a href="/t">', "{title}", "</a></h2>"),
        (None, '<a href="/en/company/">', "Companies", "</a>"),
        (None, '<a href="/en/company/x-12/">', "شركة / {company}", "</a>"),
        (False, '<p class="t-mute"><span>', "{location}", "</span><span>"),
        (False, "", "·", "</span></p>"),
        (True, '<a href="/en/egypt/jobs/x-in-maadi/">', "Maadi", "</a>"),
        (True, '<a href="/en/egypt/jobs/x-in-cairo/">', "Cairo", "</a>"),
        (None, "<section><h2>", "Job description", "</h2>"),
        (False, '<div class="t-break">', "{description}", "</div>"),
        (True, '<div class="t-break">', "{description} Easy Apply now", "</div>"),
        (None, '</section><span class="jb-salary">', "{salary}", "</span>"),
    ),
}

CARD_FIELDS = ("title", "company", "location", "date_text", "salary")
FIELDS = ("title", "company", "location", "description", "date_text", "salary", "feed")


def _escaped(text: Column) -> Column:
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(reference))
    return F.coalesce(text, F.lit(""))


def _with_escaped(view: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The view with the escaped fields in a struct `e`, computed once."""
    escaped = F.struct(*[_escaped(F.col(name)).alias(name) for name in fields])
    return compute_once(view.select("posting_no", "source", "url", "feed", "type_text", escaped.alias("e")), "e")


def _filled(text: str) -> Column:
    """A text of the markup with its field put in."""
    for name in FIELDS:
        before, field, after = text.partition("{" + name + "}")
        if field:
            return F.concat(F.lit(before), F.col(f"e.{name}"), F.lit(after))
    return F.lit(text)


def _markup(board: str) -> Column:
    parts = []
    for variant, before, text, after in PARTS[board]:
        part = F.concat(F.lit(before), _filled(text), F.lit(after))
        parts.append(part if variant is None else F.when(F.expr(ODD) == F.lit(variant), part).otherwise(""))
    return F.concat(F.lit("<html><body>"), *parts, F.lit("</body></html>"))


def _by_board(make) -> Column:
    out = F.lit(None).cast("string")
    for board in PARTS:
        out = F.when(F.col("source") == board, make(board)).otherwise(out)
    return out


def detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One detail page per posting: page_id, source, url, html; and the posting's feed."""
    view = _with_escaped(P.raw_postings(spark, sf), FIELDS)
    return view.select(F.col("posting_no").alias("page_id"), "source", "url", _by_board(_markup).alias("html"), "feed")


# Cards by board: (markup of a card, link). The link is a column; dates are where the board prints them.
CARDS = {
    "LinkedIn": ('<div data-entity-urn="urn:li:jobPosting:1"><a href="', "/jobs/view/{no}?trk=x", '">{title}</a></div>'),
    "Indeed": ('<div class="job_seen_beacon"><a href="/x">n</a><h2><b><a href="', "/rc/clk?jk=k{no}&amp;z=1", '">{title}</a></b></h2></div>'),
    "Glassdoor": (
        '<li data-test="jobListing"><a data-test="job-title" href="',
        "/job-listing/j?jl={no}",
        '">{title}</a><span class="xemployerName">{company}</span><div data-test="emp-location">{location}</div>'
        '<div data-test="detailSalary">{salary}</div><div data-test="descSnippet">{snippet}</div>'
        '<div><b>Skills:</b> {skills}</div><i data-test="job-age">{date_text}</i></li>',
    ),
    "Wuzzuf": ('<div class="job-card"><h2><a href="', "/jobs/p/{no} {kind}?o=1", '">{title}</a></h2><div class="job-date">{date_text}</div></div>'),
    "Bayt": ('<li data-js-job><h2><a href="', "/en/jobs/{no}/", '">{title}</a></h2><span id="jb-date-{no}">{date_text}</span></li>'),
}


def _card(board: str) -> Column:
    known = {name: F.col(f"e.{name}") for name in CARD_FIELDS}
    known["no"] = F.col("posting_no").cast("string")
    known["kind"] = F.col("type_text")
    known["snippet"] = F.when(F.expr(ODD), F.lit("")).otherwise(F.col("type_text"))
    known["skills"] = F.when(F.col("posting_no") % 4 < 2, "React, SQL").otherwise("")
    out, rest = [], "".join(CARDS[board])
    while rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}") if rest else ("", "", "")
        out += [F.lit(before), *([known[name]] if name else [])]
    return F.concat(*out)


def listing_pages(spark: SparkSession, sf: str, per_page: int = 8) -> DataFrame:
    """Listing pages: some postings of a board on each, and every card once more on the page after it."""
    cards = _with_escaped(P.raw_postings(spark, sf), CARD_FIELDS).select("source", "posting_no", _by_board(_card).alias("card"))
    page = F.floor(F.col("posting_no") / (5 * per_page))
    dealt = cards.select("source", "posting_no", "card", F.explode(F.array(page, page + 1)).alias("page"))
    rows = dealt.groupBy("source", "page").agg(F.sort_array(F.collect_list(F.struct("posting_no", "card"))).alias("cards"))
    boards = F.array(*map(F.lit, P.SOURCES))
    html = F.concat(F.lit("<html><body><ul>"), F.array_join("cards.card", "\n"), F.lit("</ul></body></html>"))
    number = F.col("page") * len(P.SOURCES) + F.array_position(boards, F.col("source")) - 1
    return rows.select(number.alias("page_id"), "source", F.concat(F.lit("https://list/"), number.cast("string")).alias("url"), html.alias("html"))
