"""Tagging and imputation with dictionaries that are tables (K1, K2, K5-K7), of any size.

The forms in `functions.skills` carry their dictionary as a literal; these join it. Positions travel with
the rows, so lists come back in the order of the literal forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.functions import skills as K
from postmill.functions import vocabulary as V
from postmill.operators.enrich import alias_lookup

# A token of a phrase: letters and digits, dots between or before them, plus and number signs after them.
TOKEN = r"\.?[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*[+#]*"


def implied_lists(role_skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """K5/K2 on the dictionary alone: (role, level, names), the canonical skills of all levels up to each.

    `role_skills` is the long dictionary (role, level_rank, pos, skill), `aliases` (alias, canonical).
    """
    levels = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(name).alias("level")) for r, name in enumerate(V.LEVELS)])
    upto = F.explode(F.filter(levels, lambda x: x["rank"] >= F.col("level_rank"))).alias("to")
    rows = role_skills.select("role", "level_rank", "pos", "skill", upto)
    firsts = rows.groupBy("role", F.col("to.level").alias("level"), "skill").agg(F.min(F.struct("level_rank", "pos")).alias("at"))
    named = alias_lookup(firsts, aliases).groupBy("role", "level")
    ordered = named.agg(F.sort_array(F.collect_list(F.struct("at", "canonical"))).alias("all"))
    return ordered.select("role", "level", F.col("all.canonical").alias("names"))


def enhance_by_tables(df: DataFrame, role_skills: DataFrame, aliases: DataFrame, key: str, out: str = "enhanced") -> DataFrame:
    """K7 by joins: as `enrich.with_enhancement`, for dictionaries too big to be literals. `key` must be unique.

    Extracted skills are exploded with their positions and meet the aliases; roles meet the finished lists
    of their level, a row per role and not per skill. One grouping by the key puts both back in order.
    """
    read = df.select(key, "extracted", K.detect_roles(F.col("title")).alias("roles"), K.detect_seniority(F.col("title")).alias("level"))
    spelt = alias_lookup(read.select(key, F.posexplode("extracted").alias("pos", "skill")), aliases)
    extracted = spelt.select(key, F.lit(0).alias("part"), "pos", F.array("canonical").alias("names"))
    roles = read.select(key, "level", F.posexplode("roles").alias("pos", "role"))
    implied = roles.join(implied_lists(role_skills, aliases), ["role", "level"]).select(key, F.lit(1).alias("part"), "pos", "names")
    both = extracted.unionByName(implied).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("part", "pos", "names"))).alias("_parts"))
    nothing = F.array().cast("array<struct<part:int,pos:int,names:array<string>>>")
    parts = F.coalesce("_parts", nothing)
    names = lambda n: F.flatten(F.transform(F.filter(parts, lambda p: p["part"] == n), lambda p: p["names"]))
    joined = df.join(read.drop("extracted").join(both, key, "left").withColumnRenamed("roles", "_roles"), key, "left")
    built = F.struct(
        names(0).alias("extracted"),
        names(1).alias("implied"),
        F.array_distinct(F.concat(names(0), names(1))).alias("final"),
        F.col("_roles").alias("roles"),
        F.col("level").alias("seniority"),
    )
    return joined.withColumn(out, built).drop("_parts", "_roles", "level")


def tokens(text: Column) -> Column:
    """The tokens of a text or phrase, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)


def phrase_table(spark: SparkSession) -> DataFrame:
    """The built-in tagging phrases as a dictionary table (skill, rank, phrase)."""
    rows = [
        (skill.name, rank, phrase)
        for rank, skill in enumerate(V.SKILLS)
        for phrase in (*skill.words, *skill.tags, *[word for word, _ in skill.unless])
    ]
    return spark.createDataFrame(rows, "skill string, rank int, phrase string")


def tag_by_phrases(df: DataFrame, phrases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """K1 with a dictionary table: (key, skills) of every row, in dictionary order.

    A phrase tags where its tokens follow one another, so `c#`, `c++` and `.net` are found, and a hyphen,
    a slash or any white space may part them. A match inside a longer one does not count: `sql server` is no
    `sql`, `ruby on rails` no `ruby`. `phrases` is (skill, rank, phrase); `key` must be unique; a text without
    skills has none listed.

    Each token of a text looks up the phrases that begin with it: one hash join, whatever the number of
    skills. Only matches, which are few, are shuffled.
    """
    spelt = phrases.select("skill", "rank", tokens(F.col("phrase")).alias("_t")).filter(F.size("_t") > 0)
    known = spelt.groupBy(F.array_join("_t", " ").alias("_phrase"), F.size("_t").alias("_n"), F.get("_t", 0).alias("_first")).agg(
        F.collect_set(F.struct("rank", "skill")).alias("_skills")
    )
    longest = known.agg(F.max("_n")).first()[0] or 1
    words = df.select(key, tokens(F.col(text)).alias("_t"))
    ahead = lambda t, i: F.struct(t.alias("first"), F.array_join(F.slice("_t", i + 1, longest), " ").alias("ahead"))
    each = words.select(key, F.posexplode(F.transform("_t", ahead)).alias("_at", "_w")).select(key, "_at", "_w.*")
    fits = F.startswith(F.concat("ahead", F.lit(" ")), F.concat("_phrase", F.lit(" ")))
    matches = each.join(known, F.col("first") == F.col("_first")).filter(fits)
    # Matches of a text from left to right, longer ones first: one that ends no later than an earlier one is inside it.
    before = Window.partitionBy(key).orderBy("_at", F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("_at") + F.col("_n")
    reach = matches.select(key, "_at", "_n", "_skills").withColumn("_reach", F.max(end).over(before))
    free = reach.filter(F.col("_reach").isNull() | (F.col("_reach") < end))
    tagged = free.select(key, F.explode("_skills").alias("_s")).groupBy(key).agg(F.sort_array(F.collect_set("_s")).alias("_s"))
    found = tagged.select(key, F.array_distinct("_s.skill").alias("skills"))
    return df.select(key).join(found, key, "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
