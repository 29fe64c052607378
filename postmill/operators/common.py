"""Helpers shared by operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, keep: list[str], values: Column, name: str) -> DataFrame:
    """One row per array element, the array being computed once.

    A plain explode makes the optimizer add a "not empty" filter that is pushed down with a
    second copy of the array's expression. The outer form has no such filter; its null rows
    for empty arrays are dropped after it.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def compute_once(df: DataFrame, name: str) -> DataFrame:
    """Fix a costly column's value before filters on it.

    The column passes through a one-element generator, which filters are not pushed below;
    the other columns stay prunable.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*others, F.explode_outer(F.array(F.col(name))).alias(name))


def filter_here(df: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """Filter rows by computed columns without computing them again.

    An ordinary filter is pushed below the projection it depends on by copying that
    projection's expressions into the predicate, so a costly column would be evaluated
    twice. `keep` gets the row as a struct.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns], F.lit(True).alias("_kept"))
    kept = df.select(F.inline_outer(F.filter(F.array(row), keep)))
    return kept.filter(F.col("_kept").isNotNull()).drop("_kept")
