"""Work that grows with the tables, not with the pairs in them."""

from __future__ import annotations

import random
import tracemalloc
from datetime import datetime, timedelta

import pyarrow as pa

from pyspark.sql import functions as F

from postmill.functions import html as H
from postmill.operators import matching
from postmill.operators import pages as pages_of
from postmill.operators.search import in_windows
from postmill.plans import catalogue


def most_rows(df) -> int:
    """Run a frame; the most rows that any node of its plan made."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
    return most


def test_equal_seekers_and_postings_match_once(spark):
    number = F.col("id")
    postings = spark.range(2000).select(number.alias("posting_no"), F.array(F.lit("a"), F.lit("b")).alias("skills"))
    seekers = spark.range(2000).select(number.alias("seeker"), F.array(F.lit("b"), F.lit("a"), F.lit("a")).alias("skills"))
    found = matching.match_topk(postings, seekers, k=3)
    assert most_rows(found) < 50_000  # 4 million pairs
    rows = {(r.seeker, r.rank, r.posting_no, float(r.score)) for r in found.collect()}
    assert rows == {(s, p + 1, p, 100.0) for s in range(2000) for p in range(3)}


def test_repeated_and_null_keys_match_as_rows(spark):
    postings = spark.createDataFrame([(1, ["a"]), (None, ["a"]), (1, ["a"])], "posting_no int, skills array<string>")
    seekers = spark.createDataFrame([(7, ["a"]), (7, ["a", None]), (8, None)], "seeker int, skills array<string>")
    found = matching.match_topk(postings, seekers, k=5).collect()
    assert [(r.seeker, r.rank, r.posting_no) for r in sorted(found)] == [(7, 1, None), (7, 2, None), (7, 3, 1), (7, 4, 1), (7, 5, 1)]


def totals() -> dict:
    return {"n": (F.sum, F.lit(1)), "least": (F.min, F.col("id")), "most": (F.max, F.col("id")), "all": (F.sum, F.col("id"))}


def test_totals_in_windows_equal_a_loop(spark):
    rng = random.Random(4)
    start = datetime(1969, 12, 31, 23, 59)
    instant = lambda: start + timedelta(microseconds=rng.choice((rng.randrange(200), rng.randrange(300_000_000))))
    rows = [(i, rng.choice(("a", "b", None)), instant()) for i in range(200)] + [(900, "a", None)]
    windows = [(i, instant(), instant()) for i in range(120)]
    windows += [windows[0], (None, start, start + timedelta(days=9)), (7, None, start), (8, start, None)]
    events = spark.createDataFrame(rows, "id int, kind string, at timestamp")
    table = spark.createDataFrame(windows, "run int, since timestamp, until timestamp")
    found = in_windows(events, table, "at", totals=totals(), by=["kind"]).select("run", "since", "kind", *totals())
    want = []
    for run, since, until in windows:
        for kind in ("a", "b", None):
            ids = [i for i, k, at in rows if k == kind and None not in (at, since, until) and since <= at < until]
            want += [(run, since, kind, len(ids), min(ids), max(ids), sum(ids))] if ids else []
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_totals_in_windows_make_no_pairs(spark):
    second = lambda n: F.timestamp_seconds(n)
    n = F.col("id")
    events = spark.range(3000).select("id", second(n).alias("at"))
    windows = spark.range(1000).select(n.alias("run"), second(n).alias("since"), second(n + 2000).alias("until"))
    found = in_windows(events, windows, "at", totals=totals())
    assert most_rows(found) < 200_000  # two million pairs
    assert found.agg(F.sum("n")).first()[0] == 2_000_000


def test_pages_are_held_a_few_at_a_time(spark):
    page = "<body>" + "<div class='a b'><a href='/x'>y</a></div>" * 100
    flatten = H.page_udf({"board": ["a", ".a"]}).func
    tracemalloc.start()
    out = flatten(pa.array([page] * 400 + [None]), pa.array(["board"] * 401))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 401 and out[400].as_py() is None and len(out[399].as_py()["els"]) == 202
    assert peak < 40e6


def test_batches_of_pages_are_bounded(spark):
    long = spark.range(64).coalesce(1).select(F.col("id").alias("page_id"), F.lit("Bayt").alias("source"), F.repeat(F.lit("x"), 1_000_000).alias("html"))
    pages_of.with_page(long)  # from here on

    @F.arrow_udf("int")
    def rows(html: pa.Array) -> pa.Array:
        return pa.array([len(html)] * len(html), pa.int32())

    assert long.agg(F.max(rows("html"))).first()[0] <= 8


def test_selectors_look_at_elements_that_can_match(spark, monkeypatch):
    names = ["p", ".c", "#i", "[k]", "p.c", "div > p, .c", "[k*='v'] .c", "b:contains('z')", "div:has(p)", "[class*='c']"]
    page = H._Flattener()
    page.feed("<div k='uv' class='cc c c'><p class='c'>1<b>z</b></p></div><p id='i' k>2</p>" + "<i>3</i>" * 500)
    page.finish()
    looked, matches = [0], H._matches

    def counted(*args):
        looked[0] += 1
        return matches(*args)

    for name in names:
        each = [H._steps(s) for s in name.split(", ")]
        want = [e["idx"] for e in page.els if any(matches(page, e, a) for a in each)]
        assert want and H._group(name)(page) == want
    monkeypatch.setattr(H, "_matches", counted)
    for name in names:
        H._group(name)(page)
    assert looked[0] < 60


def _tables_in_files(spark, sf, to):
    """The tables, documents in four files."""
    for name in ("documents", "pages", "customer", "nation"):
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        (table.repartition(4) if name == "documents" else table).write.parquet(f"{to}/{name}.parquet")
    return str(to)


def test_arriving_pages_are_many_files(spark, sf, tmp_path):
    folder = tmp_path / "run"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalogue._streamed_pages(spark, _tables_in_files(spark, sf, tmp_path / "in"), str(folder))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in range(catalogue.PAGE_BATCHES):
        assert len(list(folder.glob(f"pages/part={k}/*.parquet"))) > 1
    assert len(list(folder.glob("runs/run=*"))) == catalogue.PAGE_BATCHES


def test_arriving_postings_are_many_files(spark, sf, tmp_path, monkeypatch):
    folder = tmp_path / "run"
    monkeypatch.setattr(catalogue.ingest, "shared_folder", lambda _: str(folder))
    catalogue.stream_dedup(spark, _tables_in_files(spark, sf, tmp_path / "in"))
    for k in range(3):
        assert len(list(folder.glob(f"arrivals/part={k}/*.parquet"))) > 1
