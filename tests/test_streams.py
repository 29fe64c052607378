"""Streams drained with `availableNow` agree with their batch forms."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postmill.operators.dedup import new_pages
from postmill.operators.pages import detail_to_raw
from postmill.operators.search import in_window, in_windows
from postmill.plans import pipeline
from postmill.plans import posting_view as P
from postmill.sources.pages import read_pages, stream_pages
from postmill.sources.store import PostingStore
from postmill.streaming import ingest

COLUMNS = (
    "arrival long, source string, url string, title string, company string, location string, description string,"
    " salary string, skills array<string>, job_type string, posted_at timestamp, extracted_at timestamp"
)


def rows(*items):
    at = datetime(2024, 3, 31, 12)
    return [(i, "LinkedIn", url, title, "C", "L", "D", None, ["SQL"], "remote", at, at + timedelta(minutes=i)) for i, title, url in items]


def test_ingest_in_increments(spark, tmp_path):
    arrivals, root, checkpoint = (str(tmp_path / n) for n in ("arrivals", "store", "checkpoint"))
    write = lambda *items: spark.createDataFrame(rows(*items), COLUMNS).coalesce(1).write.mode("append").parquet(arrivals)
    drain = lambda: ingest.stream_ingest(
        spark.readStream.schema(COLUMNS).parquet(arrivals), root, checkpoint, P.as_of
    ).awaitTermination()
    write((1, "Alpha", "u1"), (2, "Alpha", "u2"), (3, "Beta", "u3"))
    drain()
    store = PostingStore(spark, f"{root}/star")
    assert {r.url for r in store.read().postings.collect()} == {"u1", "u3"}
    write((4, "Alpha", "u2"), (5, "Gamma", "u1"))  # a new run: signatures start afresh, stored urls stay known
    drain()
    drain()  # nothing new
    assert {r.url for r in store.read().postings.collect()} == {"u1", "u2", "u3"}
    runs = {r.run_id: (r.fetched, r.saved, r.duplicates) for r in ingest.read_runs(spark, root).collect()}
    assert runs == {"0": (3, 2, 1), "1": (2, 1, 1)}
    fresh = in_window(store.read().postings, P.as_of(), P.as_of() + F.expr("INTERVAL 1 SECOND"))
    assert fresh.count() == 3


def test_replayed_batch_changes_nothing(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "star"))
    save = ingest.ingest_batch(store, str(tmp_path / "runs"), P.as_of, lambda: "s")
    df = spark.createDataFrame(rows((1, "Alpha", "u1")), COLUMNS)
    save(df, 0)
    save(df, 0)
    assert [r.batch for r in store.rows().collect()] == ["s-000000000"] and store.read().postings.count() == 1
    assert [(r.fetched, r.saved) for r in ingest.read_runs(spark, str(tmp_path)).collect()] == [(1, 1)]


def test_streams_add_to_a_store_that_others_fill(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "star"))
    make = lambda *items: spark.createDataFrame(rows(*items), COLUMNS)
    store.append(make((1, "Zeta", "u0")), P.as_of(), "first")
    clock = iter(range(1, 9))
    now = lambda: P.as_of() + F.make_interval(hours=F.lit(next(clock)))
    for stream in ("a", "b"):  # a new checkpoint starts again at batch 0
        save = ingest.ingest_batch(store, str(tmp_path / "runs"), now, lambda s=stream: s)
        for k in range(2):
            save(make((k, f"Alpha {stream}", f"{stream}{k}"), (9, "", f"{stream}{k}-bad")), k)
            save(make((k, f"Alpha {stream}", f"{stream}{k}"), (9, "", f"{stream}{k}-bad")), k)  # replayed
    state = store.read().postings
    assert {r.url for r in state.collect()} == {"u0", "a0", "a1", "b0", "b1"}
    assert store.rejected().count() == 4
    runs = ingest.read_runs(spark, str(tmp_path)).collect()
    assert {(r.stream, r.run_id, r.fetched, r.saved, r.rejected) for r in runs} == {
        (s, k, 2, 1, 1) for s in "ab" for k in "01"
    }
    for r in runs:
        held = in_window(state, F.lit(r.since), F.lit(r.until)).collect()
        assert f"{r.stream}{r.run_id}" in {x.url for x in held}
    ends = {(r.stream, r.run_id): r for r in runs}
    assert ends["a", "0"].until == ends["a", "1"].since


def test_first_rows_of_signatures_over_batches_and_restarts(spark, tmp_path):
    src = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    known = spark.createDataFrame([("known",)], "url string")
    stream = ingest.stream_first_rows(spark.readStream.schema(COLUMNS).parquet(src), known)
    arrive = lambda *items: spark.createDataFrame(rows(*items), COLUMNS).coalesce(1).write.mode("append").parquet(src)
    drain = lambda: {(r.arrival, r.signature, r.url, tuple(r.skills)) for r in ingest.drain_to_table(stream, str(tmp_path), "out").collect()}
    arrive((2, "Alpha", "u2"), (1, "Alpha", "u1"), (3, "Beta", "known"), (4, "Gamma", "u4"))
    first = {(1, "alpha::c", "u1", ("SQL",)), (4, "gamma::c", "u4", ("SQL",))}
    assert drain() == first
    arrive((5, "Alpha", "u5"), (6, "Beta", "u6"))  # a restart: alpha is still held, beta's first row was known
    assert drain() == first | {(6, "beta::c", "u6", ("SQL",))}
    arrive((200, "Delta", "u7"))  # the watermark is now at minute 140: alpha is let go, what comes before it is late
    drain()
    arrive((210, "Alpha", "u8"), (100, "Late", "u9"))
    assert {r[0] for r in drain()} == {1, 4, 6, 200, 210}


def page(no, url, title, when="2 days ago"):
    html = f"<h2 class='top-card-layout__title'>{title}</h2><span class='posted-time-ago__text'>{when}</span>"
    return (no, url, html)


def test_page_stream_extracts_new_urls_only(spark, tmp_path):
    pages, root, checkpoint = (str(tmp_path / n) for n in ("pages", "store", "checkpoint"))
    columns = "page_id long, url string, html string"
    stream = lambda: stream_pages(spark, pages).withColumn("source", F.lit("LinkedIn"))
    arrive = lambda *items: spark.createDataFrame(items, columns).coalesce(1).write.mode("append").parquet(pages)
    drain = lambda: pipeline.stream_pages_to_store(stream(), root, checkpoint, P.as_of).awaitTermination()
    arrive(page(1, "u1", "Alpha Engineer"), page(2, "u1", "Another Name"), page(3, "u2", "Alpha Engineer"), page(4, "u4", "Old", "9 days ago"))
    drain()
    # u2 fell to its signature and was not stored, so it is new again; u1 is known and is not parsed.
    arrive(page(5, "u1", "Alpha Engineer Two"), page(6, "u2", "Alpha Engineer"), page(7, "u3", "Beta"), page(8, None, "Gamma"))
    drain()
    drain()  # nothing new
    state = {r.url: r.title for r in PostingStore(spark, f"{root}/star").read().postings.collect()}
    assert state == {"u1": "Alpha Engineer", "u2": "Alpha Engineer", "u3": "Beta"}
    runs = {r.run_id: r for r in ingest.read_runs(spark, root).collect()}
    counts = {k: (r.pages, r.extracted, r.fetched, r.saved, r.duplicates, r.rejected) for k, r in runs.items()}
    assert counts == {"0": (4, 3, 2, 1, 1, 0), "1": (4, 3, 3, 2, 0, 1)}
    assert [r.reason for r in PostingStore(spark, f"{root}/star").rejected().collect()] == ["no url"]


def test_page_runs_join_known_urls_before_the_extractor(spark):
    known = spark.createDataFrame([("u1",)], "url string")
    pages = spark.createDataFrame([page(1, "u1", "A"), page(2, "u2", "B")], "page_id long, url string, html string")
    new = new_pages(pages.withColumn("source", F.lit("Indeed")), known)
    plan = detail_to_raw(new, P.as_of())._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and plan.index("ArrowEvalPython") < plan.index("LeftAnti")  # the extractor is above the join


def test_windows_of_any_length(spark):
    start = datetime(2024, 1, 1)
    step = lambda s: start + timedelta(seconds=s)
    rng = random.Random(4)
    rows = [(i, step(rng.uniform(-5, 100_000))) for i in range(300)] + [(900, step(50)), (901, None)]
    windows = [(i, step(a := rng.uniform(0, 90_000)), step(a + rng.choice([0.000001, 1, 60, 7_000, 80_000]))) for i in range(60)]
    windows += [(90, step(50), step(50)), (91, step(60), step(50)), (92, None, step(9)), (93, step(50), step(50.000001)), (94, step(-9e6), step(9e6))]
    table = spark.createDataFrame(windows, "run long, since timestamp, until timestamp")
    events = spark.createDataFrame(rows, "id long, created_at timestamp")
    joined = in_windows(events, table)
    got = {(r.id, r.run) for r in joined.collect()}
    want = {(i, w) for i, t in rows for w, a, b in windows if t and a and a <= t < b}
    assert got == want and joined.count() == len(want)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    assert in_windows(events, table.limit(0)).count() == 0


def test_late_rows(spark):
    df = spark.createDataFrame(rows((1, "Alpha", "u1")), COLUMNS)
    assert ingest.drop_late(df, 7, P.as_of()).count() == 1
    assert ingest.drop_late(df, 7).count() == 0


def test_page_readers(spark, sf, tmp_path):
    path = str(tmp_path / "crawl")
    spark.read.parquet(f"{sf}/pages.parquet").write.parquet(path)
    n = read_pages(spark, path).count()
    drained = ingest.drain_to_table(stream_pages(spark, path).select("page_id"), str(tmp_path), "pages")
    assert drained.count() == n > 0
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "a.html").write_text("<h1>x</h1>\n<p>y</p>")
    row = read_pages(spark, str(tmp_path / "html"), "html").first()
    assert row.html == "<h1>x</h1>\n<p>y</p>" and row.url.endswith("a.html")


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert ingest.shared_folder(spark).startswith(f"{named}/postmill-")
