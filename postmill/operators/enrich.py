"""Turning raw extracted fields into enriched postings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import skills as K
from postmill.functions import vocabulary as V
from postmill.functions.dates import is_fresh
from postmill.functions.jobtype import clean_location, job_type
from postmill.functions.text import clean_text, salary_if_numeric
from postmill.functions.urls import posting_id
from postmill.schemas import POSTING


def _nothing() -> Column:
    return F.array().cast("array<string>")


def alias_lookup(df: DataFrame, aliases: DataFrame, skill: str = "skill", out: str = "canonical") -> DataFrame:
    """K2 as a join, for alias tables too big to be a literal.

    The optimizer picks the strategy from the table's size; nothing is broadcast by hand.
    """
    keyed = df.withColumn("_alias", F.lower(F.trim(F.col(skill))))
    named = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    return (
        keyed.join(named, "_alias", "left")
        .withColumn(out, F.coalesce("_canonical", F.trim(F.col(skill))))
        .drop("_alias", "_canonical")
    )


def implied_skills(df: DataFrame, role_skills: DataFrame, role: str = "role", level: str = "level") -> DataFrame:
    """K5 as a join: one row per distinct skill of the role at or below the level.

    `role_skills` is the long dictionary (role, level, level_rank, pos, skill). Distinct
    (role, level) pairs are few however many rows `df` has, so the level condition is
    resolved on those pairs and the rows meet the finished lists.
    """
    rank = F.array_position(F.array(*map(F.lit, V.LEVELS)), F.col(level)) - 1
    pairs = df.select(role, level).distinct().withColumn("_rank", rank)
    names = role_skills.select(F.col("role").alias(role), "level_rank", "pos", "skill")
    lists = (
        pairs.join(names, role)
        .filter(F.col("level_rank") <= F.col("_rank"))
        .groupBy(role, level, "skill")
        .agg(F.min(F.struct("level_rank", "pos")).alias("skill_pos"))
    )
    return df.join(lists, [role, level])


def all_roles(role_skills: DataFrame) -> DataFrame:
    """K6: the roles a dictionary knows."""
    return role_skills.select("role").distinct()


def known_roles_only(df: DataFrame, role_skills: DataFrame, role: str = "role") -> DataFrame:
    """K6: rows whose role is in the dictionary."""
    return df.join(all_roles(role_skills).withColumnRenamed("role", role), role, "left_semi")


def with_enhancement(
    df: DataFrame,
    role_skills: V.RoleSkills = V.ROLE_SKILLS,
    aliases: Mapping[str, str] | None = None,
    out: str = "enhanced",
) -> DataFrame:
    """K7: struct of extracted, implied and final skills, roles and seniority."""
    return df.withColumn(out, K.enhance_skills(F.col("title"), F.col("extracted"), role_skills, aliases))


def enhancement_report(df: DataFrame, preview: int = 20) -> DataFrame:
    """How many skills each step contributed, and the head of the final list."""
    e = F.col("enhanced")
    return df.select(
        "posting_no",
        F.array_join(e["roles"], ", ").alias("roles"),
        e["seniority"].alias("seniority"),
        F.size("extracted").alias("n_extracted"),
        F.size(e["extracted"]).alias("n_normalized"),
        F.size(e["implied"]).alias("n_implied"),
        F.size(e["final"]).alias("n_final"),
        F.array_join(F.slice(e["final"], 1, preview), ", ").alias("preview"),
    )


def with_source_skills(
    df: DataFrame,
    uniform: bool = False,
    role_skills: V.RoleSkills = V.ROLE_SKILLS,
    aliases: Mapping[str, str] | None = None,
) -> DataFrame:
    """K9: the skill list each board's rules give; `uniform` enhances every board alike.

    Optional inputs: `page_tags` (array of tag texts), `skills_line` (text).
    """
    tags = F.coalesce(F.col("page_tags"), _nothing()) if "page_tags" in df.columns else _nothing()
    line = K.extract_skills(F.col("skills_line")) if "skills_line" in df.columns else _nothing()
    # Each text is tagged once, in its own projection; the board rules only combine the arrays.
    tagged = df.withColumns(
        {
            "_title": K.extract_skills(F.col("title")),
            "_description": K.extract_skills(F.col("description")),
            "_company": K.extract_skills(F.col("company")),
            "_salary": K.extract_skills(F.col("salary")),
            "_line": line,
            "_tags": tags,
        }
    )
    title, description, company = F.col("_title"), F.col("_description"), F.col("_company")
    enhanced = K.enhance_skills(F.col("title"), K.union_skills(title, description, company), role_skills, aliases)
    with_all = tagged.withColumn("_enhanced", enhanced["final"])
    full = F.col("_enhanced")
    if uniform:
        skills = full
    else:
        skills = (
            F.when(F.col("source") == "Indeed", K.merge_skills_ci(F.concat(full, title, description, F.col("_salary"))))
            .when(F.col("source") == "Wuzzuf", K.union_skills(F.col("_tags"), title, description))
            .when(F.col("source") == "Glassdoor", K.union_skills(title, description, F.col("_line")))
            .when(F.col("source") == "Bayt", K.union_skills(title, description, company))
            .otherwise(full)
        )
    return with_all.withColumn("skills", skills).drop(
        "_title", "_description", "_company", "_salary", "_line", "_tags", "_enhanced"
    )


def cleaned(name: str) -> Column:
    """N1 on a text field, which one board's rows skip."""
    return F.when(F.col("source") == "Bayt", F.col(name)).otherwise(clean_text(F.col(name)))


def make_postings(
    raw: DataFrame,
    as_of: Column,
    uniform: bool = False,
    role_skills: V.RoleSkills = V.ROLE_SKILLS,
    aliases: Mapping[str, str] | None = None,
) -> DataFrame:
    """Enriched postings in the `schemas.POSTING` shape, plus `arrival`.

    `raw` has the `schemas.RAW_POSTING` columns; `posted_at` defaults to `as_of`.
    """
    tagged = with_source_skills(raw, uniform, role_skills, aliases)
    as_is = F.col("source") == "Bayt"
    kind = F.when(as_is, "full-time").otherwise(job_type(F.concat_ws(" ", "title", "description")))
    typed = tagged.withColumn("job_type", kind)
    shaped = typed.select(
        "arrival",
        posting_id(F.col("source"), F.col("url"), F.col("title")).alias("posting_id"),
        cleaned("title").alias("title"),
        cleaned("company").alias("company"),
        F.when(as_is, F.col("location"))
        .otherwise(clean_location(F.col("location"), F.col("job_type")))
        .alias("location"),
        cleaned("description").alias("description"),
        "url",
        F.when(as_is, F.when(F.col("salary").rlike("[0-9]"), F.col("salary")))
        .otherwise(salary_if_numeric(F.col("salary")))
        .alias("salary"),
        "skills",
        "job_type",
        "source",
        F.coalesce("posted_at", as_of).alias("posted_at"),
        as_of.alias("extracted_at"),
    )
    return shaped.select("arrival", *POSTING.names)


def fresh_only(df: DataFrame, as_of: Column) -> DataFrame:
    """D8 as a filter."""
    return df.filter(is_fresh(F.col("posted_at"), F.col("source"), as_of))
