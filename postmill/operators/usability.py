"""Usability metrics over (user, task, status, clicks, wrong_clicks) observations (M1-M7).

All are conditional aggregates: one narrow scan, partial sums per task, no collected groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves rounded up."""
    return F.floor(part / whole * 100 + 0.5).cast("long")


def one_decimal(value: Column) -> Column:
    return F.floor(value * 10 + 0.5) / 10


def _band(rate: Column, top: str = "top", middle: str = "middle", low: str = "low") -> Column:
    return F.when(rate >= 80, top).when(rate >= 60, middle).otherwise(low)


def _completed() -> Column:
    return F.count_if(F.col("status") == "C")


def completion_rate_by_user(df: DataFrame) -> DataFrame:
    """M1."""
    counted = df.groupBy("user").agg(F.count("*").alias("total"), _completed().alias("completed"))
    rated = counted.withColumn("rate", percent(F.col("completed"), F.col("total")))
    return rated.withColumn("band", _band(F.col("rate")))


def completion_rate_overall(df: DataFrame) -> DataFrame:
    """M2: completed observations over users x tasks, whether or not each pair was observed."""
    pairs = (F.count_distinct("user") * F.count_distinct("task")).alias("total")
    counted = df.agg(pairs, _completed().alias("completed"))
    return counted.withColumn("rate", percent(F.col("completed"), F.col("total")))


def click_quality(df: DataFrame) -> DataFrame:
    """M3: observations per task with 0, 1 and 2 or more wrong clicks."""
    wrong = F.col("wrong_clicks")
    counted = df.groupBy("task").agg(
        F.count_if(wrong == 0).alias("excellent"),
        F.count_if(wrong == 1).alias("acceptable"),
        F.count_if(wrong >= 2).alias("unacceptable"),
    )
    return counted.withColumns({"good": F.col("excellent") >= 6, "bad": F.col("unacceptable") >= 4})


def task_efficiency(df: DataFrame, expected: DataFrame) -> DataFrame:
    """M4: mean clicks against the expected number; `expected` is (task, expected)."""
    mean = df.groupBy("task").agg(one_decimal(F.avg("clicks")).alias("actual"))
    diff = F.col("actual") - F.col("expected")
    return mean.join(expected, "task").select(
        "task",
        "expected",
        "actual",
        F.round(diff, 1).alias("difference"),
        F.when(diff <= 1, "top").when(diff <= 2, "middle").otherwise("low").alias("band"),
    )


def names_of(df: DataFrame, column: str, most: int = 1000) -> list[object]:
    """The values of a column that is to become columns; more than `most` are no table and are refused."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return found


def matrix(df: DataFrame, rows: str, columns: str, names: Sequence[object], value: str) -> DataFrame:
    """M5/M6: pivot with the listed column values; the first observation (by value) fills a cell.

    The columns are an argument because an open-ended set of them is no table at scale.
    """
    return df.groupBy(rows).pivot(columns, list(names)).agg(F.min(value))


def click_matrix(df: DataFrame, expected: DataFrame) -> DataFrame:
    """M5: clicks of every user (rows) at every task (columns), then the tasks' means and expected clicks.

    Users are as many as the data, tasks a few: so users are the rows. `line` says what a row is.
    """
    tasks = names_of(df, "task")
    shown = lambda rows, line: rows.select(line.alias("line"), *[F.col(f"`{t}`").cast("double").alias(t) for t in tasks])
    users = shown(matrix(df, "user", "task", tasks, "clicks"), F.concat(F.lit("user "), F.col("user").cast("string")))
    means = shown(df.groupBy().pivot("task", tasks).agg(one_decimal(F.avg("clicks"))), F.lit("mean"))
    goals = shown(expected.groupBy().pivot("task", tasks).agg(F.min("expected")), F.lit("expected"))
    return users.unionByName(means).unionByName(goals)


def click_cells(df: DataFrame, expected: DataFrame) -> DataFrame:
    """M5 in long form, for any number of users: task, user, clicks (the first by value), the task's mean and expected clicks."""
    cells = df.groupBy("task", "user").agg(F.min("clicks").alias("clicks"))
    mean = df.groupBy("task").agg(one_decimal(F.avg("clicks")).alias("mean_clicks"))
    return cells.join(mean, "task").join(expected, "task", "left")


def completion_rate_by_task(df: DataFrame) -> DataFrame:
    """M6."""
    counted = df.groupBy("task").agg(F.count("*").alias("total"), _completed().alias("completed"))
    rated = counted.withColumn("rate", percent(F.col("completed"), F.col("total")))
    return rated.withColumn("verdict", _band(F.col("rate"), "Pass", "Marginal", "Fail"))


def likert_summary(df: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """M7: count and percent of each score 1-5 (scores nobody gave included) and the mean."""
    sums = [F.count_if(F.col(score) == i).alias(f"_n{i}") for i in range(1, 6)]
    counted = df.groupBy(*keys).agg(*sums, F.count("*").alias("_all"), F.avg(score).alias("_mean"))
    pairs = F.array(*[F.struct(F.lit(i).alias("score"), F.col(f"_n{i}").alias("n")) for i in range(1, 6)])
    return counted.select(*keys, "_all", "_mean", F.inline(pairs)).select(
        *keys, "score", "n", percent(F.col("n"), F.col("_all")).alias("percent"), F.round("_mean", 1).alias("mean")
    )
