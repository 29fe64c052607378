"""Every stage of the pipeline against loops over its own input."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from postmill.llm import decontaminate, secret_scan
from postmill.llm.common import shared_folder, table
from postmill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Rows after each stage by its name, documents first."""
    folder, docs = shared_folder(spark), table(spark, sf, "documents")
    out = {"documents": docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out[name] = docs.collect()
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def plain(text):
    return "".join(map(chr, decontaminate.normalised(decontaminate.points(text or ""))[0])).strip()


def test_columns(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secret_scan", "byte_bpe"]
    assert all(stages[n][0].__fields__ == corpus_pipeline.COLUMNS for n in names[:-1])


def test_toxic_documents_go(spark, sf, stages):
    scored = {r["doc_id"]: r["score"] for r in QUERIES["op7_toxicity"](spark, sf).collect()}
    assert texts(stages["toxicity"]) == {d: t for d, t in texts(stages["documents"]).items() if scored[d] < 0.5}


def test_one_of_each_group_stays(stages):
    given = texts(stages["toxicity"])
    label = brute.components(given, 80)
    assert texts(stages["near_duplicates"]) == {d: t for d, t in given.items() if label[d] == d}


def test_documents_with_benchmark_passages_go(spark, sf, stages):
    given, kept = texts(stages["near_duplicates"]), texts(stages["decontamination"])
    items = {r["item_id"]: r["text"] for r in table(spark, sf, "benchmark").collect()}
    passages = [p for p in map(plain, items.values()) if len(p) >= decontaminate.LEAST_CHARS]
    held = {d for d, t in given.items() if any(p in plain(t) for p in passages)}
    assert held and held.isdisjoint(kept) and set(kept.items()) <= set(given.items())
    # Each document that went has a place within the edit budget of a probe.
    docs = table(spark, sf, "documents").filter(F.col("doc_id").isin(list(given.keys() - kept.keys())))
    found = decontaminate.contaminated(docs, table(spark, sf, "benchmark")).collect()
    assert {r["doc_id"] for r in found} == given.keys() - kept.keys()
    for r in found:
        item, near = plain(items[r["item_id"]]), plain(given[r["doc_id"]][max(0, r["start"] - 40) : r["end"] + 40])
        starts = {*range(0, max(1, len(item) - 99), 50), max(0, len(item) - 100)}
        assert min(brute.edits(item[a : a + 100], near) for a in starts) <= 8


def test_secrets_are_masked(stages):
    given, masked = texts(stages["decontamination"]), texts(stages["secret_scan"])
    assert masked.keys() == given.keys()
    for d, text in masked.items():
        assert brute.secrets(text)[:3] == (0, 0, 0)
        if brute.secrets(given[d])[:3] == (0, 0, 0) and not secret_scan.guessed_spans(given[d] or ""):
            assert text == given[d]
    assert all(r["n_chars"] == len(r["text"] or "") for r in stages["secret_scan"] if r["text"] is not None)


def test_tokens(stages):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, text in texts(stages["secret_scan"]).items():
        ids = enc.encode_ordinary(text or "")
        want.append((d, len(ids), *(hashlib.sha256(b).hexdigest() for b in (brute.u4(ids), (text or "").encode()))))
    assert sorted(tuple(r)[:4] for r in stages["byte_bpe"]) == sorted(want)


def test_contaminated_rows_go_whatever_their_ids(spark, tmp_path):
    passage = " ".join(f"benchmark{i} passage{i % 7}" for i in range(12))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(None, f"x {passage} y"), (None, "clean"), (None, None), (1, f"x {passage} y"), (1, "clean"), (1, "clean"), (2, passage), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(i, t) for i, t in texts if passage not in (t or "")], key=str)


def test_stages_on_odd_tables(spark, sf):
    """Empty tables, nulls, empty and very long texts, repeated rows, columns with names that the operators use."""
    given = spark.read.parquet(f"{sf}/documents.parquet").schema
    long = "The river runs along the old road and nobody minds. " * 4000
    rows = [(1, long, "en", "a", 0), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (4, "Plain words.", None, None, 0), (4, "Plain words.", None, None, 0), (None, "No id here.", "en", "a", 0)]
    odd = spark.createDataFrame(rows, given).selectExpr("*", "'x' AS score", "1 AS _key", "true AS kept", "'y' AS spans")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, odd.limit(0), sf)
        assert empty.collect() == [], name
        out = stage(spark, odd, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
            assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted((r[0] or 0, r[1] or "") for r in rows), name
        else:
            assert {r["doc_id"]: r["n_tokens"] > 0 for r in out.collect()} == {1: True, 2: False, 3: False, 4: True, None: True}
