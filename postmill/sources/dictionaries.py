"""Dictionaries and selector tables from JSON files.

These files are configuration of a few kilobytes, read once when a plan is built.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import vocabulary as V

#: A dictionary that is read into a plan; a larger one is a table (`operators.dictionary`).
MAX_CHARS = 16 * 1024 * 1024


def _json_pairs(spark: SparkSession, path: str) -> list[tuple[str, object]]:
    size, text = F.length("value"), F.when(F.length("value") <= MAX_CHARS, F.col("value"))
    rows = spark.read.text(path, wholetext=True).select(size.alias("size"), text.alias("text")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: expected one file, found {'none' if not rows else 'several'}")
    if rows[0]["text"] is None:
        raise ValueError(f"{path}: {rows[0]['size']} characters; read a dictionary of more than {MAX_CHARS} as a table")
    return json.loads(rows[0]["text"], object_pairs_hook=lambda pairs: pairs)


def read_aliases(spark: SparkSession, path: str) -> dict[str, str]:
    """A flat alias -> canonical file; of duplicate keys the last one counts."""
    return dict(_json_pairs(spark, path))


def read_role_skills(spark: SparkSession, path: str) -> dict[str, dict[str, tuple[str, ...]]]:
    """A role -> level -> [skill] file."""
    return {
        role: {level: tuple(names) for level, names in dict(levels).items()}
        for role, levels in dict(_json_pairs(spark, path)).items()
    }


def read_selectors(spark: SparkSession, path: str) -> dict[str, object]:
    """A selector file: field -> [selector], possibly grouped by page kind."""

    def plain(value: object) -> object:
        if isinstance(value, list) and value and isinstance(value[0], tuple):
            return {k: plain(v) for k, v in value}
        return value

    return {k: plain(v) for k, v in _json_pairs(spark, path)}


def role_skills_table(spark: SparkSession, role_skills: V.RoleSkills = V.ROLE_SKILLS) -> DataFrame:
    """Long form (role, level, level_rank, pos, skill)."""
    return spark.createDataFrame(
        V.role_skill_rows(role_skills), "role string, level string, level_rank int, pos int, skill string"
    )


def alias_table(spark: SparkSession, aliases: dict[str, str] | None = None) -> DataFrame:
    """Long form (alias, canonical)."""
    rows = list((aliases if aliases is not None else V.alias_dictionary()).items())
    return spark.createDataFrame(rows, "alias string, canonical string")
