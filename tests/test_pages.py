"""Extraction rules on small pages of each board."""

import pytest
from pyspark.sql import functions as F

from postmill.functions import html as H
from postmill.operators import pages
from postmill.operators.enrich import make_postings
from postmill.plans import posting_view as P

LONG = "We build data platforms. " * 20

LINKEDIN = """<html><body><h2 class="top-card-layout__title"> Senior React Engineer </h2>
<h4 class="top-card-layout__second-subline"><a href="/c">Acme</a> Cairo</h4>
<div class="description__text">Use React &amp; AWS<br>daily</div><span class="posted-time-ago__text">2 days ago</span></body></html>"""
WUZZUF = f"""<body><h1>QA Engineer</h1><div class="css-d7j1kk"><a>Nile Co</a></div>
<span class="job-location">Giza · 51-200 Employees</span><div class="job-requirements">short</div><main>{LONG}</main>
<span class="job-posted-date">posted 3 days ago</span><span class="salary">9000 EGP</span>
<div class="skills"><ul><li>Selenium<li>SQL<li>x</ul></div><p class="skill-tag">Team work</p></body>"""
INDEED = """<body><style>.css-1{color:red}</style><h1 class="jobsearch-JobInfoHeader-title">Data Engineer<span> - job post</span></h1>
<div data-company-name="true"><span>.css-9ab{top:0}</span></div><a href="/cmp/Globex">Review for Globex</a>
<div data-testid="job-location">Remote in Cairo</div><div id="jobDescriptionText">Spark</div>
<div class="salary-snippet">$100,000 a year</div><script>var posted = "1 day ago";</script><footer>Posted 30+ days ago</footer></body>"""
GLASSDOOR = f"""<body><nav>menu menu</nav><h1 class="job-title">Cloud Engineer</h1><div data-test="employer-name">Initech</div>
<div data-test="location">Berlin</div><p>{LONG[:150]}</p><div class="xposted">Posted 4 days ago</div><footer>legal</footer></body>"""
BAYT = f"""<head><meta property="og:title" content="Backend Developer"></head><body><h1>Get contacted now</h1>
<a href="/en/company/">Companies</a><a href="/en/company/umbrella-123/">Umbrella</a>
<a href="/en/egypt/jobs/x-in-maadi/">Maadi</a><a href="/en/egypt/jobs/x-in-cairo/">Cairo</a>
<section><h2>Job description</h2><div class="t-break">{LONG} Easy Apply now</div></section><span class="jb-salary">Confidential</span></body>"""


@pytest.fixture(scope="module")
def details(spark):
    rows = [
        (1, "LinkedIn", "u1", LINKEDIN), (2, "Wuzzuf", "u2", WUZZUF), (3, "Indeed", "u3", INDEED),
        (4, "Glassdoor", "u4", GLASSDOOR), (5, "Bayt", "u5", BAYT), (6, "LinkedIn", "u6", "<p>no title</p>"),
        (7, "Indeed", "u7", "<h1>We can't find this page</h1>"), (8, "Wuzzuf", "u8", "<h1>Solve the CAPTCHA</h1>"),
        (9, "Glassdoor", "u9", "<h1>x</h1>Access Denied"), (10, "Bayt", "u10", "<h1>Easy Apply</h1>"),
        (11, "Wuzzuf", "u11", "<h1>Undated</h1>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, source string, url string, html string")
    raw = pages.detail_to_raw(df, P.as_of())
    stamped = raw.withColumn("at", F.date_format("posted_at", "MM-dd HH")).persist()
    return stamped, {r.source: r for r in stamped.collect()}


def test_only_postings_survive(details):
    assert set(details[1]) == {"LinkedIn", "Wuzzuf", "Indeed", "Glassdoor", "Bayt"}
    assert details[0].count() == 5


def test_linkedin(details):
    r = details[1]["LinkedIn"]
    assert (r.title, r.company, r.location) == ("Senior React Engineer", "Acme", "Acme Cairo")
    assert (r.description, r.at, r.salary) == ("Use React & AWSdaily", "03-29 12", None)


def test_wuzzuf(details):
    r = details[1]["Wuzzuf"]
    assert (r.title, r.company, r.location, r.salary, r.at) == ("QA Engineer", "Nile Co", "Giza", "9000 EGP", "03-28 12")
    assert r.description == LONG.strip()
    assert r.page_tags == ["Team work", "Selenium", "SQL"]


def test_indeed(details):
    r = details[1]["Indeed"]
    assert (r.title, r.company, r.location) == ("Data Engineer", "Globex", "Remote in Cairo")
    assert r.description == "Data Engineer position at Globex. Tech job opportunity."
    assert (r.salary, r.date_text, r.at) == ("$100,000 a year", "Posted 30+ days ago", "03-01 12")


def test_glassdoor(details):
    r = details[1]["Glassdoor"]
    assert (r.title, r.company, r.location, r.at) == ("Cloud Engineer", "Initech", "Berlin", "03-27 12")
    assert "menu" not in r.description and "legal" not in r.description and "We build data platforms." in r.description


def test_bayt(details):
    r = details[1]["Bayt"]
    assert (r.title, r.company, r.location, r.salary) == ("Backend Developer", "Umbrella", "Maadi, Cairo", None)
    assert r.description == LONG.strip() and r.at == "03-31 12"


def test_made_into_postings(details):
    made = {r.source: r for r in make_postings(details[0].drop("at"), P.as_of()).collect()}
    assert made["LinkedIn"].skills == ["React"]  # a line break adds no blank, so "AWSdaily" is one word
    assert made["Wuzzuf"].skills == ["Team work", "Selenium", "SQL"]
    assert made["Bayt"].job_type == "full-time" and made["Indeed"].job_type == "full-time"
    assert made["Indeed"].posting_id.startswith("indeed_") and len(made["Indeed"].posting_id) == 39


def test_listing_links(spark):
    rows = [
        (1, "LinkedIn", "<div class='job-result-card'><a href='https://l/jobs/view/1?x'>a</a></div>"
            "<li class='jobs-search-results__list-item'><a href='https://l/jobs/view/1?y'>a</a></li>"),
        (2, "Wuzzuf", "<div class='job-card'><h2><a href='/jobs/p/a b?x'>t</a></h2><div class='job-date'>2 months ago</div></div>"
            "<div class='job-card'><h2><a href='/jobs/p/c'>t</a></h2><div class='job-date'>2 days ago</div></div>"
            "<div class='job-card'><h2><a href='/jobs/p/d'>t</a></h2></div>"),
        (3, "Indeed", "<div data-jk='1'><a href='/x'>n</a><p><a href='/rc/clk?jk=ab1&z'>j</a></p></div>"),
        (4, "Glassdoor", "<li data-test='jobListing'><a href='/j?k=1'>j</a><i data-test='job-age'>30d+</i></li>"
            "<li data-test='jobListing'><a href='/j?k=2'>j</a><i data-test='job-age'>2d</i></li>"),
        (5, "Bayt", "<ul><li data-js-job><h2><a href='/en/j1'>j</a></h2><span id='jb-date-1'>Yesterday</span></li>"
            "<li data-js-job><h2><a href='/en/j2'>j</a></h2></li><li data-js-job><h2><a href='/en/j3'>j</a></h2>"
            "<span id='jb-date-3'>12 days ago</span></li></ul>"),
    ]
    df = spark.createDataFrame([(i, s, "u", h) for i, s, h in rows], "page_id long, source string, url string, html string")
    got = {(r.source, r.url, r.date_text) for r in pages.listing_to_links(df, P.as_of()).collect()}
    assert got == {
        ("LinkedIn", "https://l/jobs/view/1", ""),
        ("Wuzzuf", "https://wuzzuf.net/jobs/p/c", "2 days ago"),
        ("Wuzzuf", "https://wuzzuf.net/jobs/p/d", ""),
        ("Indeed", "https://www.indeed.com/viewjob?jk=ab1", ""),
        ("Glassdoor", "https://www.glassdoor.com/j?k=2", "2d"),
        ("Bayt", "https://www.bayt.com/en/j1", "Yesterday"),
    }


def test_listing_postings(spark):
    card = """<li data-test="jobListing"><a data-test="job-title" href="/j?k={k}">Dev {k}</a><span class="xemployerName">Co</span>
    <div data-test="descSnippet">Nice job</div><div><b>Skills:</b> React, SQL</div><i data-test="job-age">{age}</i>
    <div data-test="detailSalary">{pay}</div></li>"""
    html = card.format(k=1, age="3d", pay="$50K") + card.format(k=2, age="30d+", pay="") + "<li data-test='jobListing'><a href='/z'></a></li>"
    df = spark.createDataFrame([(7, "u", html)], "page_id long, url string, html string")
    rows = {r.title: r for r in pages.listing_to_postings(df, P.as_of()).collect()}
    assert set(rows) == {"Dev 1", "Unknown Title"}
    r = rows["Dev 1"]
    assert (r.company, r.location, r.salary) == ("Co", "Not Specified", "$50K")
    assert r.description == "Nice job\n\nRequired Skills: React, SQL"
    assert rows["Unknown Title"].description == "Unknown Title position at Unknown Company. Tech job opportunity."
    assert "SQL" in {s for p in make_postings(pages.listing_to_postings(df, P.as_of()), P.as_of()).collect() for s in p.skills}


def test_detail_wins_over_listing(spark):
    listing = spark.createDataFrame([("u1", "a"), ("u2", "b")], "url string, title string")
    detail = spark.createDataFrame([(2, "u2", "A"), (1, "u2", "B")], "page_id long, url string, title string")
    got = [(r.url, r.title, r.from_detail) for r in pages.detail_or_listing(listing, detail, ["title"], "page_id").collect()]
    assert sorted(got) == [("u1", "a", False), ("u2", "B", True)]
    got = [(r.url, r.title) for r in pages.detail_or_listing(listing, detail, ["title"]).collect()]
    assert sorted(got) == [("u1", "a"), ("u2", "A")]


def test_blocked_pages_by_board(spark):
    texts = ["a CAPTCHA service", "Access Denied", "fine"]
    df = spark.createDataFrame([(s, t) for s in ("LinkedIn", "Indeed", "Glassdoor") for t in texts], "source string, html string")
    kept = {(r.source, r.html) for r in pages.drop_blocked(df).collect()}
    assert {s for s, t in kept if t == texts[0]} == {"LinkedIn", "Glassdoor"}
    assert {s for s, t in kept if t == texts[1]} == {"LinkedIn", "Indeed"}
    assert len(kept) == 7


@pytest.mark.parametrize(
    "selector, texts",
    [
        ("ul > li", ["one", "two"]),
        ("div li", ["one", "two", "deep"]),
        ("#a .k[data-x^='p']", ["kk"]),
        ("li:contains('o')", ["one", "two"]),
        ("div:has(b)", ["onetwodeepkkbold"]),
        ("b, i", ["bold", "it"]),
        ("[data-x]", ["kk"]),
    ],
)
def test_selectors(spark, selector, texts):
    html = "<div id=a><ul><li>one<li>two</ul><ol><li>deep</ol><p class='j k' data-x=pq>kk</p><b>bold</b></div><i>it</i>"
    df = spark.createDataFrame([(html, "g")], "html string, g string")
    page = H.page_udf({"g": [selector]})(F.col("html"), F.col("g"))
    found = H.texts_of("page", H.hits("page", H.lit(selector)))
    got = df.select(page.alias("page")).select(F.expr(found).alias("t"))
    assert got.first().t == texts


def test_unknown_selector_is_refused():
    with pytest.raises(ValueError):
        H.page_udf({"g": ["a:nth-child(2)"]})
