"""Postings and seekers matched by skills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.operators.common import explode_once

#: Index rows of one skill that meet its seekers in one task.
SPLIT_ROWS = 100_000


def _weighted(postings: DataFrame, posting: str, weights: DataFrame | None) -> DataFrame:
    """(posting, required): a posting's distinct skills, rarest first, as (df, skill, w)."""
    named = explode_once(postings, [posting], F.array_distinct("skills"), "skill")
    # Both the counts and the lists are read from this grouping: the skills, which may be costly, are found once.
    each = named.groupBy(posting).agg(F.collect_list("skill").alias("_all")).select(posting, F.explode("_all").alias("skill"))
    df = each.groupBy("skill").agg(F.count("*").alias("df"))
    if weights is None:
        known = df.withColumn("w", F.lit(1).cast("long"))
    else:
        known = df.join(weights.select("skill", F.col("w").cast("long")), "skill", "left").na.fill(1, ["w"])
    rarest = F.sort_array(F.collect_list(F.struct("df", "skill", "w")))
    return each.join(known, "skill").groupBy(posting).agg(rarest.alias("required"))


def match_topk(
    postings: DataFrame,
    seekers: DataFrame,
    k: int = 10,
    min_score: int = 50,
    weights: DataFrame | None = None,
    posting: str = "posting_no",
    seeker: str = "seeker",
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """For every seeker the k best postings: (seeker, rank, posting, score), score at least `min_score`.

    The score is the share, in hundredths of a percent rounded down, of the weight of a posting's skills that the
    seeker has; equal scores go by posting. `weights` (skill, w) holds whole weights above 0, 1 where absent.

    A pair that reaches the score shares one of a posting's rarest skills: all the rest together would weigh too
    little. So only those enter the index, and common skills hardly join. A pair is scored where it first
    meets, at the rarest shared skill of that prefix. The index rows of a skill are split into parts of bounded
    size, each meeting the skill's seekers, so a skill that all postings hold is no single task.

    Postings that require the same score the same, and seekers that have the same get the same: each distinct
    list of required skills is indexed once, with its first `k` postings, and meets each distinct set once.
    """
    if not 1 <= min_score <= 100:
        raise ValueError("min_score is a percentage from 1 to 100")
    listed = _weighted(postings, posting, weights)
    total = F.aggregate("required", F.lit(0).cast("long"), lambda a, r: a + r["w"])
    # The shortest prefix after which less than `min_score` percent of the weight is left.
    left = F.aggregate(
        "required",
        F.struct(F.col("total").alias("rest"), F.lit(0).alias("n")),
        lambda a, r: F.when(100 * a["rest"] >= min_score * F.col("total"), F.struct((a["rest"] - r["w"]).alias("rest"), (a["n"] + 1).alias("n"))).otherwise(a),
    )
    alike = Window.partitionBy("required").orderBy(posting)
    heads = listed.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= k)
    kinds = heads.groupBy("required").agg(F.collect_list(F.struct(posting)).alias("_first"))
    index = kinds.withColumn("total", total).withColumn("_prefix", F.transform(F.slice("required", 1, left["n"]), lambda r: r["skill"]))
    rows = index.select("required", "total", "_first", "_prefix", F.explode("_prefix").alias("skill"))
    parts = rows.groupBy("skill").agg(F.ceil(F.count("*") / split_rows).cast("int").alias("_parts"))
    salted = rows.join(parts, "skill").withColumn("_salt", F.pmod(F.xxhash64("required"), "_parts").cast("int"))
    wanted = seekers.select(seeker, F.sort_array(F.array_distinct("skills")).alias("_has")).filter("_has IS NOT NULL")
    sets = wanted.select("_has").distinct()
    asked = sets.select("_has", F.explode("_has").alias("skill")).join(parts, "skill")
    asked = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    met = salted.drop("_parts").join(asked, ["skill", "_salt"])
    first = F.get(F.filter("_prefix", lambda s: F.array_contains("_has", s)), 0)
    shared = F.aggregate(F.filter("required", lambda r: F.array_contains("_has", r["skill"])), F.lit(0).cast("long"), lambda a, r: a + r["w"])
    scored = met.filter(first == F.col("skill")).withColumn("_shared", shared)
    enough = scored.filter(100 * F.col("_shared") >= min_score * F.col("total"))
    best = enough.select("_has", F.floor(10_000 * F.col("_shared") / F.col("total")).alias("_points"), F.inline("_first"))
    ranked = _top(best, "_has", posting, k).drop("rank").join(wanted, "_has")
    return _top(ranked, seeker, posting, k).select(seeker, "rank", posting, (F.col("_points") / 100).cast("decimal(5,2)").alias("score"))


def _top(scored: DataFrame, of: str, posting: str, k: int) -> DataFrame:
    """The k best rows of each value of `of`, numbered."""
    order = Window.partitionBy(of).orderBy(F.desc("_points"), posting)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
