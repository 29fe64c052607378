"""Dictionaries that are tables, and matching, against the literal forms and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.functions import vocabulary as V
from postmill.operators import dictionary, enrich, matching
from postmill.plans import posting_view as P
from postmill.sources.dictionaries import alias_table, read_aliases, role_skills_table


def test_tables_equal_the_literal_form(spark):
    """All 24 titles; a dictionary of 10,000 roles besides the known ones."""
    extracted = [["js", " React ", "SQL", "js"], [], ["k8s", "unknown thing"]]
    rows = [(i, t, extracted[i % 3]) for i, t in enumerate(P.TITLES)]
    titled = spark.createDataFrame(rows, "posting_no int, title string, extracted array<string>")
    known = role_skills_table(spark).select("role", "level_rank", "pos", "skill")
    more = spark.range(10_000).select(
        F.concat(F.lit("role "), "id").alias("role"), (F.col("id") % 3).cast("int").alias("level_rank"),
        F.lit(0).alias("pos"), F.concat(F.lit("Skill "), F.col("id") % 50).alias("skill"),
    )
    tables = dictionary.enhance_by_tables(titled, known.unionByName(more), alias_table(spark), "posting_no")
    literal = enrich.with_enhancement(titled)
    fields = ("extracted", "implied", "final", "roles", "seniority")
    read = lambda df: {r.posting_no: [r.enhanced[f] for f in fields] for r in df.collect()}
    assert read(tables) == read(literal)


def test_implied_lists_keep_first_positions(spark):
    roles = [("r", 0, 1, "b"), ("r", 0, 0, "a"), ("r", 1, 0, "c"), ("r", 1, 1, "a"), ("r", 2, 0, "B2")]
    table = spark.createDataFrame(roles, "role string, level_rank int, pos int, skill string")
    aliases = spark.createDataFrame([("c", "Sea"), ("b2", "b")], "alias string, canonical string")
    got = {r.level: r.names for r in dictionary.implied_lists(table, aliases).collect()}
    assert got == {"junior": ["a", "b"], "mid": ["a", "b", "Sea"], "senior": ["a", "b", "Sea", "b"]}


PHRASES = [
    ("C#", 0, "c#"), ("C++", 1, "C++"), (".NET", 2, ".net"), ("SQL", 3, "sql"), ("SQL Server", 4, "sql server"),
    ("Server", 5, "server"), ("Ruby", 6, "ruby"), ("Rails", 7, "ruby on rails"), ("Node.js", 8, "node.js"),
    ("CI", 9, "ci cd"), ("Two", 10, "c#"), ("SQL", 3, "structured query"), ("Nothing", 11, " - "),
]


@pytest.mark.parametrize(
    "text, skills",
    [
        ("C#, c++ and .NET.", ["C#", "C++", ".NET", "Two"]),
        ("SQL Server", ["SQL Server"]),
        ("SQL on a server", ["SQL", "Server"]),
        ("sql server sql", ["SQL", "SQL Server"]),
        ("Ruby on\n Rails; CI/CD with node.js.", ["Rails", "Node.js", "CI"]),
        ("javasql csharp", []),
        ("Structured-Query SQL", ["SQL"]),
        (None, []),
        ("", []),
    ],
)
def test_phrases(spark, text, skills):
    table = spark.createDataFrame(PHRASES, "skill string, rank int, phrase string")
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    assert dictionary.tag_by_phrases(docs, table, "id").first().skills == skills


def test_phrases_equal_a_loop(spark):
    rng = random.Random(6)
    words = ["a", "b", "c", "d+", "e.f"]
    phrases = [(f"s{i}", i, " ".join(rng.choices(words, k=rng.randrange(1, 4)))) for i in range(12)]
    docs = [(i, " ".join(rng.choices([*words, "x"], k=rng.randrange(0, 30)))) for i in range(60)]
    table = spark.createDataFrame(phrases, "skill string, rank int, phrase string")
    got = {r.id: r.skills for r in dictionary.tag_by_phrases(spark.createDataFrame(docs, "id int, text string"), table, "id").collect()}
    for i, text in docs:
        t = text.split()
        spans = [(p, p + len(q), rank, s) for s, rank, ph in phrases for q in [ph.split()] for p in range(len(t)) if t[p : p + len(q)] == q]
        inside = lambda m: any(o[0] <= m[0] and o[1] >= m[1] and o[1] - o[0] > m[1] - m[0] for o in spans)  # noqa: E731, B023
        assert got[i] == [s for _, s in sorted({(rank, s) for a, b, rank, s in spans if not inside((a, b))})]


@pytest.mark.parametrize("min_score, split", [(1, 1), (50, 3), (100, 1000)])
def test_matches_equal_a_loop(spark, min_score, split):
    rng = random.Random(min_score)
    names = [f"s{i}" for i in range(15)]
    weights = {n: rng.randrange(1, 5) for n in names[:10]}
    postings = [(i, ["s0", *rng.sample(names, rng.randrange(0, 6))]) for i in range(80)] + [(200, []), (201, ["s0", "s0"])]
    seekers = [(i, rng.sample(names, rng.randrange(0, 8)) + ["s0"] * (i % 2)) for i in range(20)]
    found = matching.match_topk(
        spark.createDataFrame(postings, "posting_no int, skills array<string>"),
        spark.createDataFrame(seekers, "seeker int, skills array<string>"),
        k=4, min_score=min_score, weights=spark.createDataFrame(list(weights.items()), "skill string, w int"), split_rows=split,
    )
    got = sorted((r.seeker, r.rank, r.posting_no, int(r.score * 100)) for r in found.collect())
    want = []
    for s, has in seekers:
        scores = []
        for p, need in postings:
            total = sum(weights.get(n, 1) for n in set(need))
            shared = sum(weights.get(n, 1) for n in set(need) & set(has))
            if shared and 100 * shared >= min_score * total:
                scores.append((-(10_000 * shared // total), p))
        want += [(s, i + 1, p, -x) for i, (x, p) in enumerate(sorted(scores)[:4])]
    assert got == sorted(want)


def test_aliases_are_data(spark):
    assert len(V.alias_dictionary()) == alias_table(spark).count()
    assert all(spelling == spelling.lower() for spelling in V.alias_dictionary())


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text('{"x": "Y", "x": "Z", "k": "L"}')
    assert read_aliases(spark, str(tmp_path / "a")) == {"x": "Z", "k": "L"}
    (tmp_path / "a" / "two.json").write_text("{}")
    with pytest.raises(ValueError, match="several"):
        read_aliases(spark, str(tmp_path / "a"))
