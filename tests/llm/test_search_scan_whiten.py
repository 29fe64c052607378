"""License scan, whitening and ranked search against loops, numpy and exact arithmetic."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import brute
from postmill.llm import license_scan, ranked_search, whitening
from postmill.llm.queries import QUERIES

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def base_places(text):
    words = LICENSE_WORD.findall(brute.lower(text or ""))
    found = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return words, sorted(found)


# --- license scan -----------------------------------------------------------------------------


def test_license_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op11_license_scan"](spark, sf).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        words, places = base_places(text)
        r, labels = got[d], {label for _, label in places}
        firsts = [i for i, _ in places] or [None]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), firsts[0], firsts[-1])
        assert r["base_labels"] == ",".join(sorted(labels))
        own = {s.split(":")[0] for s in r["spans"].split(",") if s}
        assert r["labels"] == ",".join(sorted(labels | own))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def whole_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_pieces_leave_one_untouched():
    for _, notice in license_scan.NOTICES:
        parts = license_scan.pieces(notice)
        assert len(parts) == license_scan.budget(notice) + 1
        assert "".join(p for _, p in parts) == notice
        assert all(notice[at:].startswith(p) and p for at, p in parts)


def test_every_place_within_the_budget_is_found():
    scanner, rng = license_scan.scanner(license_scan.BASE, license_scan.NOTICES), random.Random(3)
    hits = 0
    for _ in range(150):
        k = rng.randrange(len(license_scan.NOTICES))
        notice = license_scan.NOTICES[k][1]
        most, chars = license_scan.budget(notice), list(notice)
        for _ in range(rng.randrange(most + 2)):
            i = rng.choice([rng.randrange(len(chars)), 0, len(chars) - 1])
            kind = rng.randrange(3)
            chars[i : i + (kind > 0)] = [] if kind == 1 else [rng.choice("abcd ")]
        text = " ".join(("foo zz " + "".join(chars) + " bar qq the").split())
        words = text.split()
        least = min(
            whole_edits(" ".join(words[i:j]), notice)
            for i in range(len(words))
            for j in range(i + 1, len(words) + 1)
            if abs(len(" ".join(words[i:j])) - len(notice)) <= most
        )
        found = [f[3] for f in scanner.places(f" {text} ")[1] if f[0] == k]
        assert (min(found, default=None)) == (least if least <= most else None), text
        hits += least <= most
    assert hits > 60


def test_license_spans_and_edge_cases(spark):
    typo = "Über — Relesed under  the\tMIT Lisense! now"
    many = "Licensed under CC BY-SA 4.0. " * 500 + "x" * 50_000
    rows = [(1, typo, "a"), (2, None, "b"), (3, "", "c"), (4, many, "d"), (4, many, "d"), (None, "mit license", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string").withColumnRenamed("labels", "score")
    got = license_scan.license_scan(docs).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by_id[1]["n_words"] == 8  # the dash is beyond ASCII
    span = by_id[1]["spans"][0]
    assert typo[span["start"] : span["end"]] == "Relesed under  the\tMIT Lisense" and span["edits"] == 2
    assert by_id[1]["labels"] == "mit" and by_id[1]["base_labels"] == "" and by_id[1]["first_word"] is None
    assert by_id[2]["n_words"] == by_id[3]["n_words"] == 0 and by_id[3]["score"] == 0.0
    assert by_id[4]["labels"] == "cc-by-sa" and len(by_id[4]["spans"]) == 500
    assert by_id[None]["n_base"] == 1 and by_id[None]["score"] == 1.0
    clean = [("The new license plate was released under the old bridge",), ("permission to land is granted free of charge",)]
    quiet = license_scan.license_scan(spark.createDataFrame(clean, "text string").selectExpr("1 AS doc_id", "text")).collect()
    assert [r["labels"] for r in quiet] == ["", ""]
    assert license_scan.license_scan(docs.limit(0)).collect() == []


# --- whitening --------------------------------------------------------------------------------


def integer_rows(rows):
    return [[math.floor(256 * float(c)) for c in v] for v in rows]


def test_whitening_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array(integer_rows([r["embedding"] for r in rows]))
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    want = (x - sums / n) @ vectors[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    got = {(r["vec_id"], r["component"]): r for r in QUERIES["op12_whitening"](spark, sf).collect()}
    assert len(got) == 4 * len(rows)
    signs = None
    for r, v, w in zip(rows, x.tolist(), want, strict=True):
        mine = np.array([got[r["vec_id"], c]["whitened"] for c in (1, 2, 3, 4)])
        signs = np.sign(mine * w) if signs is None else signs
        assert np.allclose(mine, signs * w, atol=1e-9)
        one = got[r["vec_id"], 1]
        assert one["n"] == n and one["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(v, sums, strict=True))
        assert one["identity_error"] < 1e-10
        assert abs(one["explained"] - values[-1] / values.sum()) < 1e-12


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(-50, 50, (9, 6))
    matrix = (y.T @ y).astype(object) * 10**12
    poly = whitening.characteristic_polynomial(spark, matrix)
    for at in (0, 1, -3, 10**13):  # against the determinant in exact fractions
        rows = [[Fraction(int(at * (i == j)) - int(matrix[i, j])) for j in range(6)] for i in range(6)]
        det = Fraction(1)
        for k in range(6):
            p = next(i for i in range(k, 6) if rows[i][k])
            if p != k:
                rows[k], rows[p], det = rows[p], rows[k], -det
            det *= rows[k][k]
            for i in range(k + 1, 6):
                f = rows[i][k] / rows[k][k]
                rows[i] = [a - f * b for a, b in zip(rows[i], rows[k], strict=True)]
        assert sum(c * at**k for k, c in enumerate(poly)) == det


def test_products_beyond_doubles_are_exact():
    y = np.array([[2**61 + 1, -(2**60) - 7], [3, 2**50 + 1]])
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in (0, 1)] for i in (0, 1)]
    assert whitening.exact_product(y).tolist() == want


def test_close_and_equal_roots():
    # (x - 5)^2 (x - 3)(x - 2^40)(x - 2^40 - 1)
    poly = [1]
    for root in (5, 5, 3, 2**40, 2**40 + 1):
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    roots = [whitening.isolate(poly, k, 2**41) for k in (1, 2, 3, 4, 5)]
    assert [round(r.high / 2**whitening.FRACTION) for r in roots] == [2**40 + 1, 2**40, 5, 5, 3]
    assert [(r.larger, r.count) for r in roots] == [(0, 1), (1, 1), (2, 2), (2, 2), (4, 1)]


@pytest.mark.parametrize(
    "vectors",
    [
        # Equal variances along two axes, a copy, unusable rows, a short vector.
        [[1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, -1.0, 0.0], [1.0, 0.0, 0.0]],
        [[1.0, 2.0], [1.0, 2.5], [3.0], [0.25, -1.0], None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1e300, 0.0]],
        # Large entries and nearly equal variances.
        [[1e12, 1.0], [-1e12, 2.0], [5.0, 1e12 + 1], [7.0, -1e12]],
    ],
)
def test_whitened_fit_is_white(spark, vectors):
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    got = whitening.whitened_rows(table).collect()
    usable = [(i, v) for i, v in enumerate(vectors) if v is not None and all(c is not None and abs(256 * c) < 2.0**62 for c in v)]
    d = max(len(v) for _, v in usable)
    exact = {i: tuple(integer_rows([list(v) + [0.0] * (d - len(v))])[0]) for i, v in usable}
    ids = {exact[i]: i for i, _ in usable}
    components = max(r["component"] for r in got)
    assert len(got) == components * len(usable)
    white = np.array([[r["whitened"] for r in sorted(got, key=lambda r: r["component"]) if r["vec_id"] == i] for i in ids.values()])
    assert np.allclose(np.cov(white.T, bias=True), np.eye(components), atol=1e-6)
    assert max(r["identity_error"] for r in got) <= 1e-4
    n, sums = len(ids), [sum(c) for c in zip(*ids, strict=True)]
    for r in got:
        true = sum((n * a - s) ** 2 for a, s in zip(exact[r["vec_id"]], sums, strict=True))
        assert r["n"] == n and r["deviation"] == (true if true < 2**63 else None)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert whitening.whitened_rows(table).collect() == []


# --- ranked search ----------------------------------------------------------------------------


def ranking(docs, items, k=20):
    terms = [(d, Counter(TERM.findall(brute.lower(t or "")))) for d, t in docs]
    lengths = [sum(c.values()) for _, c in terms]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        wanted = TERM.findall(brute.lower(text or ""))
        scores = []
        for (d, c), size in zip(terms, lengths, strict=True):
            score = 0
            for t in wanted:
                if t in c:
                    m = 100 - 25 + (25 * size * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return out


def test_search_equals_the_loop(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op13_ranked_search"](spark, sf).collect()]
    assert sorted(got) == sorted(ranking(docs, items))


def test_search_over_many_shards_with_ties(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 400)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 200)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "ABC", "7"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 ünï-abc w3") for i in range(60)] + [(None, "w1 w2"), (None, "w4"), (7, "w1 w1 w1"), (5000, None), (5001, "")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(25)] + [(90, "absent"), (91, None), (92, "")]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in [*items, items[0]]], "item_id long, text string, rank int")
    got = [tuple(r) for r in ranked_search.ranked_search(frame, asked).collect()]
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(ranking(docs, items), key=key)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked_search(docs, items).collect() == []
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ranked_search.ranked_search(one, items.limit(0)).collect() == []
    # One document: ln(4 / 3) * 1000 = 287, impact 10^9 / (1000 + 1200).
    assert [tuple(r) for r in ranked_search.ranked_search(one, items).collect()] == [(1, 1, 1, 287 * (10**9 // 2200))]


def test_treap_bounds_hold_and_answers_are_exact():
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 60 * 90, 900))
    rows, columns = pairs // 90, pairs % 90
    impact = rng.integers(1, 1000, len(pairs))
    tree = ranked_search.Treap.build(rows, columns, impact)
    grid = np.zeros((60, 90), int)
    grid[rows, columns] = impact
    ids = np.arange(90) * 3
    for _ in range(50):
        asked = np.unique(rng.integers(0, 60, 6))
        weights = rng.integers(1, 9, len(asked))
        scores = weights @ grid[asked]
        want = sorted((-s, d) for s, d in zip(scores.tolist(), ids.tolist(), strict=True) if s > 0)[:7]
        assert tree.best(asked, weights, ids, 7, []) == want


def test_treap_with_far_more_terms_than_documents():
    rng = np.random.default_rng(4)
    for n_columns in (1, 2, 5):
        pairs = np.unique(rng.integers(0, 700 * n_columns, 900))
        rows, columns = pairs // n_columns, pairs % n_columns
        impact = rng.integers(1, 1000, len(pairs))
        tree = ranked_search.Treap.build(rows, columns, impact)
        assert tree.height == 10 and tree.parting == 10 - max(1, (n_columns - 1).bit_length())
        grid = np.zeros((700, n_columns), int)
        grid[rows, columns] = impact
        ids = np.arange(n_columns) * 3
        for _ in range(30):
            asked = np.unique(rng.integers(0, 700, 9))
            weights = rng.integers(1, 9, len(asked))
            scores = weights @ grid[asked]
            want = sorted((-s, d) for s, d in zip(scores.tolist(), ids.tolist(), strict=True) if s > 0)[:3]
            assert tree.best(asked, weights, ids, 3, []) == want


def test_terms_are_counted_as_the_rule_finds_them():
    rng = random.Random(3)
    alphabet = "aZ09 \n\t\x00\x7f-@[`{\x80é日😀"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(400)] + [None, "", "a", "a", "-a-", None]
    for kind in (pa.string(), pa.large_string()):
        for some in (texts, [], [None], [""]):
            want = [len(TERM.findall(t or "")) for t in some]
            assert ranked_search.term_counts(pa.array(some, kind)).tolist() == want
        assert ranked_search.term_counts(pa.array(texts, kind).slice(7, 50)).tolist() == [len(TERM.findall(t or "")) for t in texts[7:57]]


def test_a_shard_is_read_and_written_alone(spark, monkeypatch, tmp_path):
    """A task holds whole row groups: with all shards of a file in one, its memory grows with the file."""
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 400)
    docs = spark.createDataFrame([(i, f"word{i} and more words " * 4) for i in range(60)], "doc_id long, text string").coalesce(1)
    index, n_docs = ranked_search.build_index(docs, str(tmp_path / "kept"))
    files = [pq.read_metadata(f) for f in (tmp_path / "kept" / "index").glob("*.parquet")]
    groups = [m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)]
    assert n_docs == 60 and len(groups) == index.count() > 5 and set(groups) == {1}
    assert sorted(i for r in index.collect() for i in r["ids"]) == list(range(60))
