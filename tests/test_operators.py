"""Deduplication, stores, search and metrics on small tables, and against brute force."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmill.functions import dates
from postmill.functions import vocabulary as V
from postmill.functions.urls import BASE_URLS
from postmill.operators import dedup, enrich, frontier, search, stats
from postmill.operators import usability as U
from postmill.sources import dictionaries, postings, store


def at(day):
    return F.lit(f"2024-04-{day:02d}").cast("timestamp")


# --- deduplication --------------------------------------------------------------------------


def test_run_dedup_golden(spark):
    rows = [(1, "Alpha", "url1"), (2, "Alpha", "url2"), (3, "Beta", "url3"), (4, "Beta", "url4"), (5, "Gamma", "url1")]
    run = spark.createDataFrame(rows, "arrival long, title string, url string").withColumns(
        {"company": F.lit("X"), "source": F.lit("LinkedIn")}
    )
    judged = dedup.dedup_run(run, spark.createDataFrame([("url3",)], "url string"))
    got = {r.arrival: (r.status, r.reason) for r in judged.collect()}
    assert got == {
        1: ("saved", None),
        2: ("duplicate", "signature"),
        3: ("duplicate", "url"),
        4: ("duplicate", "signature"),
        5: ("duplicate", "url"),
    }
    assert stats.run_totals(judged).first().asDict() == {"fetched": 5, "saved": 1, "duplicates": 4}


@pytest.mark.parametrize("seed", range(3))
def test_run_dedup_against_loop(spark, seed):
    rng = random.Random(seed)
    # A third of the rows share one signature, another third one url.
    pick = lambda kind, i: f"{kind} hot" if i % 3 == 0 else f"{kind} {rng.randrange(40)}"
    rows = [(i, pick("title", i), pick("url", i + 1)) for i in range(300)]
    stored = {f"url {i}" for i in range(0, 40, 7)}
    seen, saved = set(), set(stored)
    want = {}
    for i, title, url in rows:
        if title in seen:
            want[i] = "duplicate"
            continue
        seen.add(title)
        want[i] = "duplicate" if url in saved else "saved"
        saved.add(url)
    run = spark.createDataFrame(rows, "arrival long, title string, url string").withColumn("company", F.col("title"))
    judged = dedup.dedup_run(run.repartition(5), spark.createDataFrame([(u,) for u in stored], "url string"))
    assert {r.arrival: r.status for r in judged.collect()} == want


def test_url_dedup(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "arrival long, url string")
    assert {(r.arrival, r.url) for r in dedup.dedup_urls(df).collect()} == {(1, "a"), (2, "b")}


# --- stores ---------------------------------------------------------------------------------

POSTING = (
    "arrival long, source string, url string, title string, company string, location string, description string,"
    " salary string, skills array<string>, job_type string, posted_at timestamp"
)


def batch(spark, *rows):
    full = [
        (i, source, url, title, "C", "L", "D", None, skills, "remote", datetime(2024, 3, 1))
        for i, source, url, title, skills in rows
    ]
    return spark.createDataFrame(full, POSTING)


def test_upsert_keeps_identity_and_updates_the_rest(spark):
    first = store.upsert_star(
        store.empty_star(spark),
        batch(spark, (1, "A", "u1", "old", [" X ", "", "Y"]), (2, "B", "u1", "newer", ["Z"]), (3, "B", "u2", "t", [])),
        at(1),
    )
    row = first.postings.filter("url = 'u1'").first()
    assert (row.source, row.title, row.job_type) == ("A", "newer", "FULL_TIME")
    assert {r.name for r in first.skills.collect()} == {"X", "Y", "Z"}
    second = store.upsert_star(first, batch(spark, (4, "C", "u1", "newest", ["Y", "W"])), at(2))
    row = second.postings.filter("url = 'u1'").first()
    assert (row.source, row.title, row.created_at.day, row.updated_at.day) == ("A", "newest", 1, 2)
    shown = store.assemble(second, at(3)).filter("url = 'u1'").first()
    assert shown.skills == ["W", "X", "Y", "Z"] and shown.job_type == "full-time"
    days = {r.name: (r.created_at.day, r.updated_at.day) for r in second.skills.collect()}
    assert days == {"X": (1, 1), "Y": (1, 2), "Z": (1, 1), "W": (2, 2)}
    again = store.upsert_star(second, batch(spark, (4, "C", "u1", "newest", ["Y", "W"])), at(2))
    for table in ("postings", "skills", "links"):
        a, b = getattr(second, table), getattr(again, table)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bad_rows_are_set_aside(spark):
    good, bad = store.validate(batch(spark, (1, "A", "u", "t", []), (2, "A", None, "t", []), (3, "A", "v", "", [])))
    assert [r.arrival for r in good.collect()] == [1]
    assert {r.arrival for r in bad.collect()} == {2, 3}


def test_store_of_batches(spark, tmp_path):
    disk, state = store.PostingStore(spark, str(tmp_path / "star")), store.empty_star(spark)
    assert disk.read().postings.count() == 0 and disk.urls().count() == 0
    batches = [
        ((1, "A", "u1", "t", ["X"]), (2, "A", "u2", "t", ["X", " Y "]), (7, "B", "u2", "again", ["V"])),
        ((3, "B", "u1", "new", ["Z"]), (4, "A", "", "t", [])),
        ((5, "A", "u3", "t", ["Y"]), (6, "A", "u2", "new", [])),
    ]
    for day, items in enumerate(batches, 1):
        state = store.upsert_star(state, batch(spark, *items), at(day))
        for _ in range(2):  # a batch run again replaces its rows
            disk.append(batch(spark, *items), at(day), f"s-{day:03d}")
        for name in ("postings", "skills", "links"):
            a, b = getattr(state, name), getattr(disk.read(), name)
            assert a.exceptAll(b.select(a.columns)).count() == 0 and a.count() == b.count()
    assert {r.url for r in disk.urls().collect()} == {"u1", "u2", "u3"}
    assert {r.url for r in disk.urls(without="s-003").collect()} == {"u1", "u2"}
    found = store.search_star(disk.read(), ["x"], at(4), limit=1).collect()
    assert len(found) == 1 and found[0].skills == ["X"]
    with pytest.raises(ValueError):
        disk.append(batch(spark, *batches[0]), at(1), "a/b")
    assert [(r.arrival, r.reason) for r in disk.rejected().collect()] == [(4, "no url")]


def test_run_counters_of_silent_and_failed_boards(spark):
    df = spark.createDataFrame([("Bayt", "saved"), ("Bayt", "duplicate"), ("LinkedIn", "saved")], "source string, status string")
    boards = spark.createDataFrame([("Bayt",), ("Indeed",), ("LinkedIn",)], "source string")
    failed = spark.createDataFrame([("LinkedIn",)], "source string")
    got = {r.source: (r.fetched, r.saved, r.duplicates, r.success) for r in stats.run_counters(df, boards, failed).collect()}
    assert got == {"Bayt": (2, 1, 1, True), "Indeed": (0, 0, 0, False), "LinkedIn": (1, 1, 0, False)}


@pytest.mark.parametrize("seed", range(3))
def test_replace_flat_against_loop(spark, seed):
    rng = random.Random(seed)
    stored = [(f"i{k}", f"u{k}", "old") for k in range(12)]
    rows = [(n, f"i{rng.randrange(20)}", f"u{rng.randrange(20)}", "new") for n in range(40)]
    want = {(i, u): t for i, u, t in stored}
    for _, i, u, t in rows:
        want = {k: v for k, v in want.items() if k[0] != i and k[1] != u}
        want[(i, u)] = t
    before = spark.createDataFrame(stored, "posting_id string, url string, title string")
    arrivals = spark.createDataFrame(rows, "arrival long, posting_id string, url string, title string")
    after = postings.replace_flat(before, arrivals)
    assert {(r.posting_id, r.url): r.title for r in after.collect()} == want


def test_source_registry(spark):
    df = spark.createDataFrame([("Bayt", datetime(2024, 1, 2)), ("Bayt", datetime(2024, 1, 3))], "source string, extracted_at timestamp")
    row = store.registry_rows(df, BASE_URLS).first()
    assert (row.name, row.url, row.total, row.last_fetched.day) == ("Bayt", BASE_URLS["Bayt"], 2, 3)


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"jira": "Project Management", "x": "X", "jira": "JIRA"}')
    (tmp_path / "r.json").write_text(json.dumps({"ml": {"junior": ["A"], "mid": ["B"], "senior": []}}))
    (tmp_path / "s.json").write_text(json.dumps({"search": {"url": ["h2 a"]}, "title": ["h1"]}))
    assert dictionaries.read_aliases(spark, str(tmp_path / "a.json")) == {"jira": "JIRA", "x": "X"}
    roles = dictionaries.read_role_skills(spark, str(tmp_path / "r.json"))
    assert V.implied("ml", "senior", roles) == ["A", "B"]
    assert dictionaries.read_selectors(spark, str(tmp_path / "s.json")) == {"search": {"url": ["h2 a"]}, "title": ["h1"]}


def test_implied_join_equals_expression(spark):
    rows = [(r, lv) for r in V.ROLE_SKILLS for lv in V.LEVELS] + [("nobody", "mid")]
    df = spark.createDataFrame(rows, "role string, level string")
    got = enrich.implied_skills(df, dictionaries.role_skills_table(spark)).groupBy("role", "level").agg(
        F.sort_array(F.collect_list(F.struct("skill_pos", "skill")))["skill"].alias("names")
    )
    assert {(r.role, r.level): r.names for r in got.collect()} == {
        (r, lv): V.implied(r, lv) for r, lv in rows if V.implied(r, lv)
    }
    assert enrich.all_roles(dictionaries.role_skills_table(spark)).count() == len(V.ROLE_SKILLS)


# --- search ---------------------------------------------------------------------------------


def test_skill_search_forms(spark):
    df = spark.createDataFrame([("p", ["React", "React Native", "SQL"])], "posting_id string, skills array<string>").withColumn(
        "posted_at", at(1)
    )
    assert search.by_skills_substring(df, ["react"]).first().skills == ["React", "React Native"]
    assert search.by_skills_element(df, ["react"]).first().skills == ["React", "React Native", "SQL"]
    js = df.withColumn("skills", F.array(F.lit("JavaScript")))
    assert search.by_skills_substring(js, ["java"]).count() == 1
    assert search.by_skills_substring(js, ["j_va%t"]).count() == 1
    assert search.by_skills_element(js, ["java"]).count() == 0
    assert search.by_skills_substring(js, []).count() == 1
    with pytest.raises(ValueError):
        search.by_skills_element(js, [])


def test_undated_postings(spark):
    df = spark.createDataFrame([("a", None), ("b", datetime(2024, 1, 1))], "posting_id string, posted_at timestamp")
    assert [r.posting_id for r in search.recent_postings(df).collect()] == ["a", "b"]
    assert [r.posting_id for r in search.recent_postings(df, nulls_first=False).collect()] == ["b", "a"]


def test_parameters():
    assert [search.parse_limit(v) for v in (None, "x", "0", "7", 5)] == [100, 100, 100, 7, 5]
    with pytest.raises(ValueError):
        search.parse_limit("-1")
    assert search.csv_param(" react, ,node.js ") == ["react", "node.js"]
    with pytest.raises(ValueError):
        search.recent_window(datetime(2024, 1, 1), 0)


def test_windows_are_half_open(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 3)], "created_at timestamp")
    got = search.in_window(df, F.lit(datetime(2024, 1, 1)), F.lit(datetime(2024, 1, 3)))
    assert [r.created_at.day for r in got.orderBy("created_at").collect()] == [1, 2]


def test_frontier_caps(spark):
    terms = spark.createDataFrame([(f"term {i}",) for i in range(30)], "term string")
    places = spark.createDataFrame([(f"place {i}",) for i in range(9)], "location string")
    rows = frontier.search_frontier(terms, places, "Indeed", n_terms=6, per_term=2, total=11).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(11))
    assert len({r.location for r in rows}) == 2 and len({r.term for r in rows}) == 6
    assert rows[0].url == f"https://www.indeed.com/jobs?q={rows[0].term.replace(' ', '%20')}&l={rows[0].location.replace(' ', '%20')}&fromage=7&sort=date"
    few = frontier.search_frontier(terms, places.limit(1), "Indeed", n_terms=5, per_term=2, total=5)
    assert sorted(r.position for r in few.collect()) == [0, 1, 2, 3, 4]
    bayt = frontier.search_frontier(terms, places, "Bayt", seed=1).first()
    assert bayt.url == f"https://www.bayt.com/en/{bayt.location.replace(' ', '-')}/jobs/{bayt.term.replace(' ', '-')}-jobs/"


def test_long_counts_of_relative_dates(spark):
    df = spark.createDataFrame([("30000 minutes ago",), ("99999999999999999999 minutes ago",), ("9" * 15 + " weeks ago",)], "t string")
    at = F.lit("2024-03-31 12:00:00").cast("timestamp")
    got = df.select(F.date_format(dates.parse_linkedin(F.col("t"), at), "yyyy-MM-dd HH:mm").alias("d")).collect()
    assert [r.d for r in got] == ["2024-03-10 16:00", None, None]
    months = spark.createDataFrame([("30000 months ago",), ("24 months ago",)], "t string")
    got = months.select(F.date_format(dates.parse_bayt(F.col("t"), at), "yyyy-MM-dd").alias("d")).collect()
    assert [r.d for r in got] == [None, "2022-03-31"]


# --- metrics --------------------------------------------------------------------------------


def test_usability_metrics(spark):
    rows = [("u", f"t{i}", "C" if i else "F", c, w) for i, (c, w) in enumerate(zip([9, 8, 8, 4, 7, 5, 12], [0, 0, 1, 3, 0, 2, 1]))]
    df = spark.createDataFrame(rows, "user string, task string, status string, clicks long, wrong_clicks long")
    r = U.completion_rate_by_user(df).first()
    assert (r.completed, r.total, r.rate, r.band) == (6, 7, 86, "top")
    assert U.completion_rate_overall(df).first().rate == 86
    wrong = df.withColumn("task", F.lit("t"))
    q = U.click_quality(wrong).first()
    assert (q.excellent, q.acceptable, q.unacceptable) == (3, 2, 2)
    clicks = spark.createDataFrame([("t", c) for c in (9, 10, 11, 9, 10, 9, 8, 10, 8, 10)], "task string, clicks long")
    e = U.task_efficiency(clicks, spark.createDataFrame([("t", 8)], "task string, expected long")).first()
    assert (e.actual, e.difference, e.band) == (9.4, 1.4, "middle")
    expected = spark.createDataFrame([("t0", 8)], "task string, expected long")
    m = {r.line: (r.t0, r.t1) for r in U.click_matrix(df, expected).collect()}
    assert m == {"user u": (9.0, 8.0), "mean": (9.0, 8.0), "expected": (8.0, None)}
    with pytest.raises(ValueError):
        U.names_of(df, "task", most=2)
    scores = spark.createDataFrame([(s,) for s in (5, 5, 5, 4, 4, 4, 4, 3, 3, 3)], "score int")
    got = {r.score: (r.n, r.percent, r["mean"]) for r in U.likert_summary(scores).collect()}
    assert got == {1: (0, 0, 4.0), 2: (0, 0, 4.0), 3: (3, 30, 4.0), 4: (4, 40, 4.0), 5: (3, 30, 4.0)}


def test_click_cells_hold_every_user(spark):
    rows = [("t", u, c) for u, c in ((0, 5), (0, 3), (8, 9), (16, 4))] + [("s", 8, 1)]
    df = spark.createDataFrame(rows, "task string, user long, clicks long")
    got = U.click_cells(df, spark.createDataFrame([("t", 8)], "task string, expected long"))
    assert sorted(map(tuple, got.select("task", "user", "clicks", "mean_clicks", "expected").collect())) == [
        ("s", 8, 1, 1.0, None), ("t", 0, 3, 5.3, 8), ("t", 8, 9, 5.3, 8), ("t", 16, 4, 5.3, 8)]


def test_envelope_refuses_longer_answers(spark):
    df = spark.range(3)
    assert postings.result_envelope(df, 3, "rows").first().body == '{"success":true,"count":3,"rows":[{"id":0},{"id":1},{"id":2}]}'
    with pytest.raises(Exception, match="more than 2 rows"):
        postings.result_envelope(df, 2).collect()


def test_success_rule(spark):
    df = spark.createDataFrame([("Wuzzuf", 0, False), ("Wuzzuf", 1, False), ("Bayt", 0, False), ("Bayt", 0, True)], "s string, n long, f boolean")
    got = [r.v for r in df.select(stats.run_success(F.col("s"), F.col("n"), F.col("f")).alias("v")).collect()]
    assert got == [False, True, True, False]


def test_limit_takes_the_leading_number():
    from postmill.operators.search import parse_limit

    assert [parse_limit(v) for v in ("12abc", "12.7", None, "x", "0", 5, " 7 ")] == [12, 12, 100, 100, 100, 5, 7]
