"""Exact url lists as a cascade of Bloom filters, and host/path rules before them.

Level 1 holds the listed keys; level 2 the keys of the corpus that pass level 1 without being listed;
level 3 the listed keys that pass level 2; and so on until nothing passes wrongly. Over the key
universe it was built for the cascade is exact: a key is listed if the number of levels it
passes before it fails one is odd. Keys are dealt into segments, each with its own small filters.

The cascade of a list of up to `MAX_LITERAL_BITS` reaches the rows as a scalar subquery, so rows are judged
in place, without a join or a shuffle. A larger one is joined by segment, with the segments copied over
`SALTS` salts so that no segment's rows meet in one task.

Edge cases: a null url has empty host and path, the key '', no rule and is judged like any other key;
null keys of a list are left out; repeated keys and rows are harmless; an empty list blocks nothing;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import ascii_lower, shared_folder, staged

#: Listed keys of a segment, about, and hash functions of a level (half of a filter's bits are set,
#: so a foreign key passes one level in 2^HASHES).
SEGMENT_KEYS, HASHES = 2_000, 5
BITS_PER_KEY = HASHES / 0.6931

#: Cascades up to this many bits (8 MB) are shipped with the plan.
MAX_LITERAL_BITS = 64_000_000
SALTS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of (verdict, host, path) that fits, as a struct of rule and verdict; else null.

    A rule fits its host and all subdomains if the path starts with its path. Of rules as long as each
    other the one with the longer host wins, then the first.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in reversed(order):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _segment(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("segment"), key), F.lit(segments)).cast("int")


def _bit(key: Column, level: int, j: int, bits: Column) -> Column:
    """Place of the key's j-th bit in a filter of `bits` bits."""
    return F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), bits)


def _passes(key: Column, level: int, words: Column) -> Column:
    """Whether the key passes a filter of 64-bit words; an absent or empty filter lets nothing pass."""
    bits = F.nullif(F.size(words).cast("long") * 64, F.lit(0).cast("long"))
    at = F.array(*[F.xxhash64(F.lit(level), F.lit(j), key) for j in range(HASHES)])

    def is_set(h: Column) -> Column:
        place = F.pmod(h, bits)
        return F.getbit(F.get(words, F.floor(place / 64).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1

    return F.coalesce(F.forall(at, is_set), F.lit(False))


def _filters(keys: DataFrame, level: int) -> DataFrame:
    """One filter (array of 64-bit words) per segment of (segment, key)."""
    size = keys.groupBy("segment").agg(F.ceil(F.count("*") * BITS_PER_KEY / 64).alias("n_words"))
    placed = keys.join(size, "segment").select(
        "segment",
        "n_words",
        F.explode(F.array(*[_bit(F.col("key"), level, j, F.col("n_words") * 64) for j in range(HASHES)])).alias("at"),
    )
    at = F.col("at")
    word = placed.groupBy("segment", F.floor(at / 64).alias("i")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))).alias("w")
    )
    empty = size.select("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_words") - 1)).alias("i"), F.lit(0).cast("long").alias("w"))
    whole = word.select("segment", "i", "w").union(empty).groupBy("segment", "i").agg(F.bit_or("w").alias("w"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"])
    return whole.groupBy("segment").agg(ordered.alias("words"))


@dataclass(frozen=True)
class Cascade:
    """Filters by level and segment: the table (level, segment, words)."""

    filters: DataFrame
    levels: int
    segments: int
    literal: bool

    def flag(self, df: DataFrame, key: str, name: str = "listed") -> DataFrame:
        """The rows with `name`: whether `key` is listed. Exact for keys of the universe."""
        segment = _segment(F.col(key), self.segments)
        if not self.levels:
            return df.withColumn(name, F.lit(False))
        if self.literal:
            held = df.withColumns({f"_w{k}": F.get(self._literal(k), segment) for k in range(self.levels)})
            return held.withColumn(name, self._listed(key)).select(*df.columns, name)
        pivot = self.filters.groupBy("segment").agg(
            *[F.first(F.when(F.col("level") == k, F.col("words")), ignorenulls=True).alias(f"_w{k}") for k in range(self.levels)]
        )
        copies = pivot.withColumnRenamed("segment", "_segment").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = df.withColumn("_segment", segment).withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int"))
        judged = salted.join(copies, ["_segment", "_salt"], "left")
        return judged.withColumn(name, self._listed(key)).select(*df.columns, name)

    def _listed(self, key: str) -> Column:
        return _odd([_passes(F.col(key), k, F.col(f"_w{k}")) for k in range(self.levels)])

    def _literal(self, level: int) -> Column:
        """All segments' filters of a level as one array, by a scalar subquery."""
        spark = self.filters.sparkSession
        every = spark.range(self.segments).select(F.col("id").cast("int").alias("segment"))
        have = self.filters.filter(F.col("level") == level).select("segment", "words")
        empty = F.array().cast("array<bigint>")
        rows = every.join(have, "segment", "left").select("segment", F.coalesce("words", empty).alias("words"))
        return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "words"))), lambda x: x["words"]).alias("w")).scalar()


def _odd(passes: list[Column]) -> Column:
    """Whether the number of levels passed before the first failure is odd."""
    out = F.lit(len(passes) % 2 == 1)
    for k, p in reversed(list(enumerate(passes))):
        out = F.when(p, out).otherwise(F.lit(k % 2 == 1))
    return out


def build_cascade(universe: DataFrame, listed: DataFrame, max_levels: int = 40) -> Cascade:
    """The cascade of the keys of `listed` over those of `universe` (one column `key` each).

    Each level is decided on what passed the level before, so all levels together read a small
    multiple of the distinct keys; only counts come to the driver.
    """
    folder = shared_folder(universe.sparkSession)
    both = universe.select("key", F.lit(False).alias("on")).union(listed.select("key", F.lit(True).alias("on")))
    keys = staged(both.filter("key IS NOT NULL").groupBy("key").agg(F.max("on").alias("on")), folder, "keys")
    n = keys.filter("on").count()
    segments = max(1, -(-n // SEGMENT_KEYS))
    keys = keys.withColumn("segment", _segment(F.col("key"), segments))
    inside, outside = keys.filter("on").select("segment", "key"), keys.filter("NOT on").select("segment", "key")
    parts, total, levels = [], 0, 0
    while n:
        if levels == max_levels:
            raise RuntimeError("the cascade does not close: keys collide in every hash")
        own = staged(_filters(inside, levels), folder, f"filter-{levels}")
        parts.append(own.select(F.lit(levels).alias("level"), "segment", "words"))
        total += n * BITS_PER_KEY
        if n * BITS_PER_KEY <= MAX_LITERAL_BITS:
            one = Cascade(parts[-1], levels + 1, segments, True)._literal(levels)
            tested = outside.withColumn("words", F.get(one, F.col("segment")))
        else:
            tested = outside.join(own, "segment")
        passed = tested.filter(_passes(F.col("key"), levels, F.col("words"))).select("segment", "key")
        wrong = staged(passed, folder, f"passed-{levels}")
        inside, outside, n = wrong, inside, wrong.count()
        levels += 1
    filters = parts[0] if parts else universe.sparkSession.createDataFrame([], "level int, segment int, words array<bigint>")
    for p in parts[1:]:
        filters = filters.union(p)
    return Cascade(filters, levels, segments, total <= MAX_LITERAL_BITS)


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    is_listed: Callable[[DataFrame], DataFrame],
    url: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict and listed. `is_listed` picks the rows whose keys are listed.

    The key of a url is its host and path. A rule's verdict comes first; else listed keys are blocked.
    """

    def keyed(df: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col(url))
        return df.withColumns({"_host": host, "_path": path}).withColumn("_key", F.concat("_host", "_path"))

    universe = keyed(pages.select(url)).select(F.col("_key").alias("key"))
    listed = keyed(is_listed(pages)).select(F.col("_key").alias("key"))
    rows = keyed(pages.select("page_id", url))
    rows = rows.withColumn("_rule", fitting_rule(F.col("_host"), F.col("_path"), rules))
    judged = build_cascade(universe, listed).flag(rows, "_key", "listed")
    return judged.select(
        "page_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )
