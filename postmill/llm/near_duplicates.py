"""Near-duplicate documents by min-max hashing, with every link confirmed on the full sets.

A document's set is its distinct 5-word shingles (lower case A-Z; shorter texts are one shingle).
Equal sets fall together first, by a 128-bit digest. Each permutation of the shingle hashes gives two
signature values, the minimum and the maximum, so 70 hash evaluations make 28 bands of five values:
a pair of similarity 0.85 shares no band once in ten million times.

Candidates are compared in tasks of two bounded sides, never as rows of pairs:
1. the members of a bucket against its smallest member (for a bucket of two that is all);
2. buckets of three and more whose members are not yet one component: overlapping ones are united, the
   members dealt into blocks, and each pair of blocks is one task, unless both blocks lie in one component
   that is known already. Should a united group grow beyond `LARGEST_GROUP`, its buckets
   are taken one by one.
A task reads full texts, rebuilds the sets and returns a spanning forest of the links it finds. So work
in a large group without early links grows with the square of its blocks in tasks, in memory it
does not grow.

The joins over all documents are merge joins at every size: both sides grow with the corpus.

Edge cases: a null or empty text, or one without words, has the empty set and no links; null doc_ids take
no part (component_id null, kept true); repeated rows of one doc_id are each returned; if their texts
differ, each text has its own links and comparisons read one of the texts; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bytes_of, shared_folder, staged, text_chunks
from postmill.llm.components import components

SHINGLE = 5
BANDS, BAND_VALUES = 28, 5

#: Members of one side of a comparison task, about.
BLOCK = 128

#: Members of a united group up to which its block pairs are compared as a whole.
LARGEST_GROUP = 50_000

_rng = np.random.Generator(np.random.PCG64(20_241))
MULTIPLY = _rng.integers(0, 2**64, BANDS * BAND_VALUES // 2, np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 2**64, BANDS * BAND_VALUES // 2, np.uint64)
PLACE = _rng.integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)
#: Which signature values make a band.
DEALT = _rng.permutation(BANDS * BAND_VALUES).reshape(BANDS, BAND_VALUES)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets of 64-bit shingle hashes, sorted within each text, and their sizes."""
    known: dict[bytes, int] = {}
    flat, counts = [], []
    for text in texts:
        words = text.translate(LOWER).split()
        counts.append(len(words))
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            flat.append(h)
    n_words = np.array(counts, np.int64)
    # Texts shorter than a shingle are filled up with a value no word has, their length told by the filling.
    n_rows = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    words = np.array(flat + [0] * SHINGLE, np.uint64)
    begins = np.cumsum(n_words) - n_words
    doc = np.repeat(np.arange(len(texts)), n_rows)
    first = begins[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n_rows) - n_rows, n_rows)
    left = n_words[doc]
    hashes = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE):
        word = np.where(k < left, words[np.minimum(first + k, len(words) - 1)], np.uint64(k + 1))
        hashes += _mix(word * PLACE[k])
    hashes = _mix(hashes)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        hashes, doc = hashes[new], doc[new]
    return hashes, np.bincount(doc, minlength=len(texts))


def band_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of band keys per text with a non-empty set, in order."""
    sizes = sizes[sizes > 0]
    starts = np.cumsum(sizes) - sizes
    values = np.empty((len(sizes), BANDS * BAND_VALUES), np.uint64)
    if len(sizes):
        for k in range(len(MULTIPLY)):
            permuted = hashes * MULTIPLY[k] + ADD[k]
            permuted ^= permuted >> np.uint64(29)
            values[:, 2 * k] = np.minimum.reduceat(permuted, starts)
            values[:, 2 * k + 1] = np.maximum.reduceat(permuted, starts)
    keys = np.zeros((len(sizes), BANDS), np.uint64)
    for v in range(BAND_VALUES):
        keys = _mix(keys + values[:, DEALT[:, v]])
    return (keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and band keys (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            hashes, sizes = shingle_sets(bytes_of(chunk))
            ends = np.cumsum(sizes)
            digests = [
                xxhash.xxh3_128_digest(hashes[e - n : e].tobytes()) if n else None
                for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)
            ]
            keys = iter(band_keys(hashes, sizes))
            bands = [next(keys) if n else None for n in sizes]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<bigint>")


def linked_pairs(left: list[int], right: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (left x right, by position) whose sets are similar enough."""
    sizes = np.array([len(s) for s in sets], np.int64)
    rows, parent = [], list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    bounds = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1], True])
    number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    shared = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
    number = np.cumsum(np.r_[0, (np.diff(number[shared]) > 0)]) if shared.any() else number[:0]
    owner = owner[shared]
    common = np.zeros((len(left), len(right)), np.float32)
    width = 1 << 13  # columns of the incidence matrices at a time
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(number, [at, at + width])
        full = np.zeros((len(sets), width), np.float32)
        full[owner[lo:hi], number[lo:hi] - at] = 1
        common += full[left] @ full[right].T
    both = sizes[left][:, None] + sizes[right][None, :]
    # 100 i >= p (a + b - i), in whole numbers.
    inter = common.astype(np.int64)
    for i, j in np.argwhere((100 + percent) * inter >= percent * both).tolist():
        a, b = left[i], right[j]
        if a != b and (ra := root(a)) != (rb := root(b)):
            parent[ra] = rb
            rows.append((a, b))
    return rows


def compared(tasks: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found by tasks of (task, side, id): side 0 against side 1."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["id"].unique()
        place = {i: k for k, i in enumerate(ids.tolist())}
        first = rows.drop_duplicates("id")
        hashes, sizes = shingle_sets([t.encode() if t else b"" for t in first["text"]])
        sets = np.split(hashes, np.cumsum(sizes)[:-1])
        sides = [[place[i] for i in rows["id"][rows["side"] == s].unique().tolist()] for s in (0, 1)]
        found = linked_pairs(*sides, sets, percent)
        return pd.DataFrame({"a": [ids[a] for a, _ in found], "b": [ids[b] for _, b in found]}, dtype="int64")

    rows = tasks.join(texts, "id")
    return rows.groupBy("task").applyInPandas(run, "a long, b long")


def _united(links: DataFrame, comp: DataFrame, buckets: DataFrame, folder: str) -> DataFrame:
    """Tasks of step 2: (task, side, id) for the buckets that hold more than one component."""
    labelled = buckets.join(comp, "id", "left").select("bucket", "id", "n", F.coalesce("label", "id").alias("label"))
    labelled = staged(labelled.filter("n > 2"), folder, "labelled")
    mixed = staged(
        labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("first")).filter("lo <> hi").select("bucket", "first"),
        folder,
        "mixed",
    )
    open_ = staged(labelled.join(mixed, "bucket").select("bucket", "first", "id", "label"), folder, "open")
    groups = components(open_.select(F.col("first").alias("a"), F.col("id").alias("b")), folder, "groups")
    sizes = groups.groupBy("label").agg(F.count("*").alias("members"))
    groups = staged(groups.join(sizes, "label").select("id", F.col("label").alias("united"), "members"), folder, "groups")
    # A group is a united one, or a single bucket where the united one is too large.
    member = open_.join(groups, "id").select(
        F.when(F.col("members") <= LARGEST_GROUP, F.concat_ws(":", F.lit("u"), "united"))
        .otherwise(F.concat_ws(":", F.lit("b"), "bucket"))
        .alias("group"),
        "id",
        "label",
    )
    member = staged(member.distinct(), folder, "members")
    # Components of a block or more get blocks of their own; the others share blocks.
    per = member.groupBy("group", "label").agg(F.count("*").alias("n"))
    large = F.col("n") >= BLOCK
    own = F.when(large, F.col("label"))
    per = staged(per.select("group", "label", own.alias("own"), "n"), folder, "per-component")
    blocks = per.groupBy(F.col("group").alias("group_"), F.col("own").alias("own_")).agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    blocks = staged(blocks, folder, "blocks")
    dealt = member.join(per, ["group", "label"]).join(
        blocks, (F.col("group") == F.col("group_")) & F.col("own").eqNullSafe(F.col("own_"))
    )
    part = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = staged(dealt.select("group_", "id", "own", part.alias("part")), folder, "dealt")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    named = blocks.select(F.col("group_").alias("group"), F.col("own_").alias("own"), parts.alias("part"))
    left = named.select("group", F.col("own").alias("own_l"), F.col("part").alias("part_l"))
    right = named.select("group", F.col("own").alias("own_r"), F.col("part").alias("part_r"))
    order = lambda side: F.struct(F.coalesce(F.col(f"own_{side}"), F.lit(-(2**63))), F.col(f"part_{side}"))
    pairs = left.join(right, "group").filter(order("l") <= order("r")).filter("own_l IS NULL OR own_r IS NULL OR own_l <> own_r")
    pairs = pairs.withColumn("task", F.concat_ws("/", "group", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("own_l", "part_l", "own_r", "part_r")]))
    pairs = staged(pairs, folder, "block-pairs")
    sides = [
        pairs.join(
            dealt,
            (F.col("group") == F.col("group_")) & F.col(f"own_{s}").eqNullSafe(F.col("own")) & (F.col(f"part_{s}") == F.col("part")),
        ).select("task", F.lit(k).alias("side"), "id")
        for k, s in enumerate(("l", "r"))
    ]
    return sides[0].union(sides[1])


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept."""
    folder = shared_folder(docs.sparkSession)
    signed = staged(signatures(docs), folder, "signed")
    usable = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = staged(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")), folder, "classes")
    reps = classes.select("digest", F.col("rep").alias("doc_id"))
    keyed = usable.select("digest", "doc_id", "bands").join(reps.hint("merge"), ["digest", "doc_id"])
    keyed = staged(keyed.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket")), folder, "keyed")
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
    shared = staged(shared, folder, "shared")
    buckets = staged(keyed.join(shared.hint("merge"), "bucket"), folder, "buckets")
    ids = buckets.select("id").distinct().withColumnRenamed("id", "doc_id")
    texts = staged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(ids.hint("merge"), "doc_id")
        .select(F.col("doc_id").alias("id"), "text"),
        folder,
        "texts",
    )
    stars = staged(buckets.filter("id <> first").select("first", "id").distinct(), folder, "stars")
    fans = stars.groupBy("first").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    fans = staged(fans, folder, "fans")
    task = F.concat_ws(":", "first", "part")
    leaves = stars.join(fans, "first").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    hubs = fans.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = leaves.select(task.alias("task"), F.lit(1).alias("side"), "id").union(
        hubs.select(task.alias("task"), F.lit(0).alias("side"), F.col("first").alias("id"))
    )
    links = staged(compared(staged(tasks, folder, "star-tasks"), texts, percent), folder, "star-links")
    comp = components(links, folder, "star")
    more = compared(staged(_united(links, comp, buckets, folder), folder, "block-tasks"), texts, percent)
    more = staged(more, folder, "block-links")
    if not more.isEmpty():
        comp = components(links.union(more), folder, "all")
    label = comp.select(F.col("id").alias("rep"), "label")
    found = staged(classes.join(label, "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id")), folder, "found")
    return signed.select("doc_id", "n_shingles", "digest").join(found.hint("merge"), "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )
