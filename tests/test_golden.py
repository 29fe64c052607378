"""Golden rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from postmill.functions import dates as D
from postmill.functions import jobtype as J
from postmill.functions import skills as K
from postmill.functions import text as N
from postmill.functions import urls as U
from postmill.functions import vocabulary as V
from postmill.plans import posting_view as P


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    row = tuple(values.values()) or ("",)
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def column_of(spark, texts, build):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", build(F.col("t")).alias("v"))
    return [r.v for r in df.orderBy("i").collect()]


TAGS = {
    P.TAILS[0]: ["React", "AWS", "Docker"],
    P.TAILS[1]: ["JavaScript", "TypeScript", "PostgreSQL", "Kubernetes"],
    P.TAILS[2]: ["JavaScript", "React", "Node.js", "React Native"],
    P.TAILS[3]: [],
    P.TAILS[4]: ["C#", "ASP.NET"],
    P.TAILS[5]: ["CI/CD", "REST API", "GraphQL", "API Development"],
    P.TAILS[6]: ["Java"],
    P.TAILS[7]: ["Rust"],
    P.TAILS[8]: ["AWS", "Big Data"],
    P.TAILS[9]: ["Machine Learning", "Data Analysis"],
}
EDGES = {
    "babel only": ["Build Tools"],
    "webpack and gatsby": ["Build Tools", "Gatsby"],
    "rust developer": [],
    "rust programming": ["Rust"],
    "ruby on rails": ["Ruby on Rails"],
    "ruby, rails": ["Ruby", "Ruby on Rails"],
    "sql server and sqlserver": ["SQL Server"],
    "php8 bs5 angular15": ["PHP", "Angular", "Bootstrap"],
    "server  side\njs": ["JavaScript", "Node.js"],
    "serversidejs": ["Node.js"],
    "éjs": ["JavaScript"],
    "real-time next.js": ["JavaScript", "WebSockets", "Next.js"],
    "go developer": ["Go"],
    "go": [],
    "c#x c++y": ["C#", "C++"],
    "emscript": ["JavaScript"],
    "": [],
}


def test_skill_tags(spark):
    cases = {**TAGS, **EDGES}
    assert column_of(spark, cases, K.extract_skills) == list(cases.values())
    assert column_of(spark, cases, K.extract_skills_plain) == list(cases.values())
    assert column_of(spark, [None], K.extract_skills) == [[]]


def test_gated_tags_equal_plain_tags(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = [p for s in V.SKILLS for p in s.words + s.tags] + ["java script", "ruby on rails", "sql server", "rust", "/", "."]
    vocabulary = F.array(*map(F.lit, words))
    word = lambda i: F.get(vocabulary, (F.xxhash64("doc_id", F.lit(i)) % len(words)).cast("int"))
    mixed = F.concat_ws(" ", F.substring("text", 1, 200), *[word(i) for i in range(12)])
    both = docs.select(K.extract_skills(mixed).alias("a"), K.extract_skills_plain(mixed).alias("b"))
    assert both.filter("a <> b").count() == 0
    assert both.select(F.sum(F.size("a"))).first()[0] > 500


SENIORITY = "junior senior mid mid mid mid mid mid mid mid mid mid senior mid mid junior senior senior senior mid mid mid mid senior".split()
ROLES = [
    ["frontend"], ["frontend"], ["fullstack"], ["devops"], ["qa"], ["ml"], ["ui-ux"], ["mobile", "embedded"],
    ["data", "data-science"], ["devops", "platform"], ["devops", "site-reliability"], ["devops", "cloud"], [],
    ["embedded"], [], ["backend"], [], ["software-architecture"], [], ["game-dev"], ["analytics"],
    ["technical-writer"], [], ["security"],
]


def test_seniority_and_roles(spark):
    assert column_of(spark, P.TITLES, K.detect_seniority) == SENIORITY
    assert column_of(spark, P.TITLES, K.detect_roles) == ROLES


@pytest.mark.parametrize(
    "title, roles",
    [
        ("web developer java", []),
        ("web developer", ["frontend"]),
        ("cloud engineer aws", ["cloud"]),
        ("operations manager", []),
        ("ml model reviewer", []),
        ("ML Researcher", ["ml"]),
        ("Unity developer", ["game-dev"]),
        ("Solutions engineer cloud", ["cloud"]),
        ("UX/UI designer", ["ui-ux"]),
    ],
)
def test_role_conditions(spark, title, roles):
    assert one(spark, K.detect_roles(F.col("t")), t=title) == roles


def test_enhanced_sizes(spark):
    """Titles whose roles are in the built-in dictionary."""
    sizes = {0: 8, 1: 26, 2: 19, 3: 18, 4: 14, 12: 0, 14: 0, 15: 8, 16: 0, 18: 1, 22: 0}
    build = lambda t: K.enhance_skills(t, K.extract_skills(t))["final"]
    final = column_of(spark, P.TITLES, build)
    assert {i: len(final[i]) for i in sizes} == sizes
    assert final[0] == [
        "Frontend Development", "HTML", "CSS", "JavaScript", "Git", "DOM", "Responsive Design", "Chrome DevTools",
    ]


def test_role_dictionary_is_an_input(spark):
    own = {"ml": {"junior": ["Python", "kafka"], "mid": ["Keras", "Python"], "senior": ["Ray"]}}
    e = one(spark, K.enhance_skills(F.col("t"), F.array(F.lit(" k8s ")), own), t="ML Engineer")
    assert e.implied == ["Python", "Big Data", "Keras"]
    assert e.final == ["Kubernetes", "Python", "Big Data", "Keras"]
    assert (e.roles, e.seniority) == (["ml"], "mid")


def test_levels_grow():
    for role in V.ROLE_SKILLS:
        junior, mid, senior = (set(V.implied(role, lv)) for lv in V.LEVELS)
        assert junior <= mid <= senior
    assert V.implied("unknown", "senior") == []


def test_aliases(spark):
    cases = {
        "react.js": "React", "ReactJS": "React", " nodejs ": "Node.js", "k8s": "Kubernetes", "postgres": "PostgreSQL",
        "jira": "JIRA", "Kafka": "Big Data", "Unheard Thing": "Unheard Thing", "analytics": "Data Analysis",
        "data science": "Data Science", "Webpack": "Build Tools", ".NET": "C#", "flutter": "Flutter", "go": "Go",
    }
    assert column_of(spark, cases, K.normalize_skill) == list(cases.values())
    table = V.alias_dictionary()
    assert all(V.normalize(v, table) == v for v in table.values())


def test_merge_ignores_case(spark):
    assert one(spark, K.merge_skills_ci(F.split("t", ",")), t="a,B,A,b,c") == ["a", "B", "c"]


def test_job_types(spark):
    cases = {
        "Summer internship": "internship", "Intern manager": "full-time",
        "Graduate role, 2 years of experience": "full-time", "Remote contractor": "contract",
        "Part time remote": "part-time", "Work from home": "remote", "International sales": "full-time",
        "Freelance part-time": "contract", "Engineer": "full-time", "intern ational": "full-time",
        "éintern": "internship",
    }
    assert column_of(spark, cases, J.job_type) == list(cases.values())
    trip = {"remote": "full-time", "freelance": "contract", None: "full-time", "Part Time": "part-time"}
    assert column_of(spark, trip, lambda k: J.job_type_from_store(J.job_type_to_store(k))) == list(trip.values())


def test_remote_locations(spark):
    cases = {"Remote, Cairo": "Cairo", "Cairo (Remote)": "Cairo ()", "Remote": "Remote", "- Remote -": "-"}
    assert column_of(spark, cases, lambda t: J.clean_location(t, F.lit("remote"))) == list(cases.values())
    assert one(spark, J.clean_location(F.col("t"), F.lit("contract")), t=" Remote, Cairo") == "Remote, Cairo"


def test_clean_text(spark):
    cases = {
        "  Senior\n\tDev  ": "Senior Dev", "new3 days ago new5": "3 days ago new5", "Rea…d more": "Read more",
        "New Relic": "New Relic", " x　y﻿": "x y", "renew3 New4": "renew3 4",
    }
    cleaned = column_of(spark, cases, N.clean_text)
    assert cleaned == list(cases.values())
    stable = [c for c in cleaned if "new" not in c.lower()]
    assert column_of(spark, stable, N.clean_text) == stable


def test_signatures(spark):
    cases = [
        ("Senior React.js Developer (Remote)", "Acme, Inc.", "senior react developer::acme inc"),
        ("C++ Engineer II", "A&B", "engineer::a b"),
        ("Go UI QA", "X", "::x"),
        ("مهندس برمجيات", "شركة", "::"),
    ]
    df = spark.createDataFrame(cases, "t string, c string, want string")
    got = df.select("want", N.signature(F.col("t"), F.col("c")).alias("got"))
    assert got.filter("want <> got").count() == 0
    assert one(spark, N.signature(F.col("t"), F.col("c"), unicode=True), t="مهندس برمجيات", c="شركة") != "::"


def test_small_cleanups(spark):
    assert one(spark, N.company_bilingual(F.col("t")), t="شركة/ Albadwy ") == "Albadwy"
    assert one(spark, N.company_bilingual(F.col("t")), t="Only/") == "Only"
    assert one(spark, N.company_strip_prefix(F.col("t")), t="Work at Review for X") == "X"
    assert one(spark, N.location_strip_headcount(F.col("t")), t="Cairo · 51-200 Employees") == "Cairo"
    assert one(spark, N.salary_if_numeric(F.col("t")), t="Competitive") is None
    parts = F.array(*map(F.lit, ["·", "Cairo", "3 days ago", "Easy Apply", "Giza"]))
    assert one(spark, N.location_from_parts(parts)) == "Cairo, Giza"
    assert one(spark, N.location_from_parts(F.array().cast("array<string>"))) == "Remote"
    links = F.array(*map(F.lit, ["Maadi", "Cairo", "Egypt", "all jobs"]))
    assert one(spark, N.location_from_parts(parts, links)) == "Maadi, Cairo"
    assert one(spark, N.description_cut(F.col("t")), t="Good job.\nEasy Apply now\nmore") == "Good job."


def test_urls(spark):
    cases = [
        ("https://x/jobs/view/1?trk=a", "LinkedIn", "https://x/jobs/view/1"),
        ("/rc/clk?jk=abc12&from=x", "Indeed", "https://www.indeed.com/viewjob?jk=abc12"),
        ("/nothing", "Indeed", None),
        ("/jobs/p/a b?o=1", "Wuzzuf", "https://wuzzuf.net/jobs/p/a-b"),
        ("/job?x=1", "Glassdoor", "https://www.glassdoor.com/job?x=1"),
        ("/en/job/1", "Bayt", "https://www.bayt.com/en/job/1"),
    ]
    df = spark.createDataFrame(cases, "u string, s string, want string")
    assert df.filter(~F.equal_null(U.canonical_url(F.col("u"), F.col("s")), "want")).count() == 0


N_, D_ = "2024-03-31 12:00:00", None
DATES = {
    "3 days ago": ["2024-03-28 12:00:00"] * 5,
    "5 hours ago": ["2024-03-31 07:00:00"] * 5,
    "2 weeks ago": ["2024-03-17 12:00:00"] * 5,
    "45 minutes ago": ["2024-03-31 11:15:00", D_, D_, "2024-03-28 12:00:00", N_],
    "1 month ago": [N_, "2024-03-01 12:00:00", "2024-03-02 12:00:00", "2024-03-28 12:00:00", "2024-03-01 12:00:00"],
    "yesterday": [N_, "2024-03-30 12:00:00", "2024-03-30 12:00:00", "2024-03-28 12:00:00", "2024-03-30 12:00:00"],
    "today": [N_] * 5,
    "Just posted": [N_, D_, N_, N_, N_],
    "30+ days ago": [N_, D_, D_, "2024-03-01 12:00:00", "2024-03-01 12:00:00"],
    "14d": [N_, D_, D_, "2024-03-28 12:00:00", "2024-03-17 12:00:00"],
    "30d+": [N_, D_, D_, "2024-03-28 12:00:00", "2024-03-01 12:00:00"],
    "il y a 2 jours": ["2024-03-29 12:00:00", D_, D_, "2024-03-28 12:00:00", N_],
    "منذ 3 أيام": [N_, "2024-03-28 12:00:00", D_, "2024-03-28 12:00:00", N_],
    "أمس": [N_, "2024-03-30 12:00:00", D_, "2024-03-28 12:00:00", N_],
    "2024-03-20": ["2024-03-20 00:00:00", "2024-03-20 00:00:00", D_, "2024-03-20 00:00:00", "2024-03-20 00:00:00"],
}
BOARDS = ["LinkedIn", "Wuzzuf", "Bayt", "Indeed", "Glassdoor"]


def test_relative_dates(spark):
    rows = [(t, b, want) for t, row in DATES.items() for b, want in zip(BOARDS, row)]
    posted = D.parse_posted(F.col("t"), F.col("b"), P.as_of())
    df = spark.createDataFrame(rows, "t string, b string, want string")
    got = df.withColumn("got", F.date_format(posted, "yyyy-MM-dd HH:mm:ss"))
    assert got.filter(~F.equal_null("want", "got")).collect() == []


def test_freshness_limits(spark):
    rows = [
        ("LinkedIn", "2024-03-24 12:00:00", True), ("LinkedIn", "2024-03-24 11:59:59", False),
        ("Wuzzuf", "2024-03-17 12:00:00", True), ("Wuzzuf", "2024-04-02 00:00:00", True),
        ("Bayt", "2024-04-02 00:00:00", False), ("Bayt", "2024-03-24 12:00:00", True), ("Bayt", None, False),
    ]
    df = spark.createDataFrame(rows, "b string, t string, want boolean")
    fresh = D.is_fresh(F.col("t").cast("timestamp"), F.col("b"), P.as_of())
    assert df.filter(fresh != F.col("want")).count() == 0


def test_huge_counts_are_old(spark):
    posted = D.parse_posted(F.lit("99999999999999999999999 days ago"), F.lit("Wuzzuf"), P.as_of())
    assert one(spark, D.is_fresh(posted, F.lit("Wuzzuf"), P.as_of())) is False
