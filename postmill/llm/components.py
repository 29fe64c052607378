"""Connected components of a link table, each document's label its smallest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import staged


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, label) for every id of `links` (a, b); ids without links are absent.

    Every round hangs each id on the smallest id next to it and on that one's own parent, and
    carries the links over to the parents (links inside a tree vanish), until none is left: the
    number of rounds grows with the logarithm of the longest chain. Minima are taken before the
    shuffle, each round ends in a written table, and nothing is collected but a count.
    """
    edges = staged(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(),
        folder,
        f"{name}-edges-0",
    )
    parents: DataFrame | None = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.union(edges.select("b", "a"))
        hung = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("up"))
        hung = staged(hung, folder, f"{name}-hung-{turn}")
        # Trees of minima may be chains: climb until every id points to a root (a smallest id of its own).
        step = 0
        while True:
            step += 1
            over = hung.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            higher = staged(
                hung.join(over, "up", "left").select("id", F.coalesce("upper", "up").alias("up"), (F.col("upper") < F.col("up")).alias("moved")),
                folder,
                f"{name}-hung-{turn}-{step}",
            )
            hung = higher.select("id", "up")
            if higher.filter("moved").isEmpty():
                break
        to_a, to_b = (hung.select(F.col("id").alias(c), F.col("up").alias(f"up_{c}")) for c in ("a", "b"))
        lifted = edges.join(to_a, "a").join(to_b, "b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
        edges = staged(lifted.filter("a <> b").distinct(), folder, f"{name}-edges-{turn}")
        if parents is None:
            parents = hung
        else:
            then = hung.select(F.col("id").alias("up"), F.col("up").alias("_up"))
            parents = staged(parents.join(then, "up", "left").select("id", F.coalesce("_up", "up").alias("up")), folder, f"{name}-parents-{turn}")
    if parents is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return parents.select("id", F.col("up").alias("label"))
