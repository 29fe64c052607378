"""Each registered query against plain loops or the public libraries, on whole tables."""

import base64
import hashlib
import zlib

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import brute
from postmill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    return {r["doc_id"]: r["text"] for r in rows}


def rows(spark, sf, name):
    return [tuple(r) for r in QUERIES[name](spark, sf).collect()]


def test_token_output(spark, sf, documents):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for d in sorted(documents):
        ids = [*t.encode(documents[d] or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(brute.u4(ids))))
        start += len(ids)
    assert sorted(rows(spark, sf, "op4_token_output")) == want


def test_byte_bpe(spark, sf, documents):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, text in documents.items():
        ids = enc.encode_ordinary(text or "")
        digests = [hashlib.sha256(b).hexdigest() for b in (brute.u4(ids), (text or "").encode())]
        want.append((d, len(ids), *digests))
    assert sorted(rows(spark, sf, "op6_byte_bpe")) == sorted(want)


def test_quality_rules(spark, sf, documents):
    got = {r[0]: r[1:] for r in rows(spark, sf, "op8_quality_rules")}
    assert set(got) == set(documents)
    for d, text in documents.items():
        want = brute.quality(text)
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got[d][:6] == (*want, failed)
        assert not (failed and got[d][6])


def test_secret_scan(spark, sf, documents):
    got = {r[0]: r[1:] for r in rows(spark, sf, "op9_secret_scan")}
    for d, text in documents.items():
        assert got[d][:4] == brute.secrets(text)
        base = [s for s in got[d][4].split(",") if s and not s.startswith("guess")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == got[d][3]


def test_near_duplicates(spark, sf, documents):
    label = brute.components(documents)
    want = sorted((d, len(brute.shingles(t)), label[d], label[d] == d) for d, t in documents.items())
    assert sorted(rows(spark, sf, "op10_near_duplicates")) == want


def test_toxicity_learns(spark, sf, documents):
    got = {r[0]: r[1:] for r in rows(spark, sf, "op7_toxicity")}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert set(got) == set(documents)
    assert all(got[d][0] == brute.held_out(d) and 0 <= got[d][1] <= 1 for d in got)
    test = [(got[d][2], y) for d, y in labels.items() if d in got and got[d][0]]
    assert sum(p == y for p, y in test) >= 0.85 * len(test)
