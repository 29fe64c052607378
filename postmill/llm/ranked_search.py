"""Ranked lexical search over K2-treaps: a compressed quadtree over a grid of terms and documents.

Tasks cut the documents into shards of bounded text. A shard's grid has a row per term and a column per
document, ascending by doc_id; a cell that holds a pair carries the pair's impact. The quadtree halves
both sides at each level; a cell keeps the largest impact inside it and a mask of its non-empty quarters,
and a cell with one pair alone is an end that names the pair, so that no chain leads down to it.

A search follows all rows of an item down at once: a range of documents is bounded by the sum, over the
item's terms, of weight times the largest impact of the cell on the term's path, and the ranges with the
highest bounds are halved first. A range of one document has its exact score. The search ends when no range
can beat the last of the best; a task carries those from one of its shards to the next.

The index is written under the shared folder and holds every term of every document; a shard is a row group
of its own there, so that a task which reads or writes it holds one shard at a time, whatever the size of the
file. Items are searched in blocks of bounded size, each block against all shards.

Edge cases: a null or empty text has no terms and is found by no item; null doc_ids come first among equal
scores; repeated doc_ids are documents of their own. An item is a distinct pair of id and text; one
without terms that occur has no rows. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm.common import ascii_lower, shared_folder, small_batches, staged

#: A term: digits, letters and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Bytes of text in a shard (a longer single text is a shard of its own).
SHARD_BYTES = 4 << 20

#: Bytes of terms that a block of items may hold.
BLOCK_BYTES = 4 << 20

#: Ranges halved in one step.
STEP = 64

#: The same rule on bytes: separators become spaces, A-Z small letters.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

#: Bytes that are part of a term.
IN_TERM = np.frombuffer(FOLD, np.uint8) != 32

#: A shard's row is a row group: readers and writers hold whole groups. Its values are long and all different.
ROW_GROUPS = {
    "parquet.block.row.count.limit": 1,
    "parquet.enable.dictionary": "false",
    "parquet.column.statistics.enabled": "false",
}

#: Stands for a null doc_id, which comes first.
NO_ID = -(1 << 63)

INDEX = (
    "ids array<long>, terms binary, df binary, height int, masks binary, maxima binary, end_rows binary, end_columns binary"
)


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of tf occurrences in documents of so many terms, in 64-bit integers."""
    m = 100 - 25 + (25 * lengths * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(n_docs: int, df: Column) -> Column:
    """Weight of a term that so many documents hold."""
    return F.floor(F.lit(1000.0) * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def interleaved(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Numbers whose base-4 digits name the quarter at each level: row bit, then column bit."""
    code = np.zeros(len(rows), np.uint64)
    for b in range(int(max(rows.max(initial=0), columns.max(initial=0))).bit_length()):
        code |= ((rows >> b) & 1).astype(np.uint64) << np.uint64(2 * b + 1)
        code |= ((columns >> b) & 1).astype(np.uint64) << np.uint64(2 * b)
    return code


@dataclass
class Treap:
    """A shard's quadtree: its cells level by level, those of one parent side by side.

    `masks` name a cell's non-empty quarters (0: an end with one pair), `maxima` hold the largest impact in
    it; `end_rows` and `end_columns` are the pairs of the ends in the order of the cells.
    """

    height: int
    masks: np.ndarray
    maxima: np.ndarray
    end_rows: np.ndarray
    end_columns: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, impact: np.ndarray) -> Treap:
        """The quadtree of distinct pairs."""
        side = int(max(rows.max(initial=0), columns.max(initial=0)))
        height = max(1, side.bit_length())
        code = interleaved(rows, columns)
        order = np.argsort(code)
        code, rows, columns, impact = code[order], rows[order], columns[order], impact[order]
        masks, maxima, ends = [], [], []
        starts = np.zeros(min(1, len(code)), np.int64)  # the root is one cell of all pairs
        active = np.arange(len(code))
        for level in range(height + 1):
            counts = np.diff(np.append(starts, len(active)))
            if not len(starts):
                break
            maxima.append(np.maximum.reduceat(impact[active], starts))
            ends.append(active[starts[counts == 1]])
            parted = counts > 1
            mask = np.zeros(len(starts), np.uint8)
            if parted.any():
                inside = np.repeat(parted, counts)
                active = active[inside]
                prefix = code[active] >> np.uint64(2 * (height - level - 1))
                starts = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
                child = prefix[starts]
                parents = np.flatnonzero(np.append(True, child[1:] >> np.uint64(2) != child[:-1] >> np.uint64(2)))
                mask[parted] = np.bitwise_or.reduceat((1 << (child & np.uint64(3)).astype(np.int64)).astype(np.uint8), parents)
            else:
                starts = np.zeros(0, np.int64)
            masks.append(mask)
        kinds = ((masks, np.uint8), (maxima, np.int64), (ends, np.int64))
        masks, maxima, ends = (np.concatenate(a) if a else np.zeros(0, t) for a, t in kinds)
        return cls(height, masks, maxima, rows[ends], columns[ends])

    @cached_property
    def empty(self) -> int:
        """A last cell, which stands for an empty quarter."""
        return len(self.masks)

    @cached_property
    def down(self) -> np.ndarray:
        """The cells of the four quarters: children are numbered as their parents are."""
        down = np.full(4 * (self.empty + 1), self.empty, np.int32)
        quarters = np.flatnonzero((self.masks[:, None] >> np.arange(4, dtype=np.uint8)) & 1)
        down[quarters] = np.arange(1, len(quarters) + 1, dtype=np.int32)
        return down

    @cached_property
    def most(self) -> np.ndarray:
        return np.append(self.maxima.astype(np.int32, copy=False), np.int32(0))

    def _of_ends(self, values: np.ndarray) -> np.ndarray:
        out = np.full(self.empty + 1, -1, np.int32)
        out[:-1][self.masks == 0] = values
        return out

    @cached_property
    def row(self) -> np.ndarray:
        """Of the cells that are ends; -1 of others."""
        return self._of_ends(self.end_rows)

    @cached_property
    def column(self) -> np.ndarray:
        return self._of_ends(self.end_columns)

    @cached_property
    def parting(self) -> int:
        """The last level whose first range holds all documents: above it, halves of documents part nothing."""
        return self.height - max(1, int(self.end_columns.max(initial=0)).bit_length())

    def descended(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row at the level `parting`."""
        cells = self.of_rows(np.zeros(len(rows), np.int32), rows)
        for level in range(self.parting):
            quarter = cells * 4 + ((rows >> (self.height - 1 - level)) & 1) * 2
            cells = self.of_rows(np.where(self.row[cells] >= 0, cells, self.down[quarter]), rows)
        return cells

    def of_rows(self, cells: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The cells, but for ends that are of another row."""
        held = self.row[cells]
        cells[(held >= 0) & (held != rows)] = self.empty
        return cells

    def halves(self, cells: np.ndarray, rows: np.ndarray, levels: np.ndarray, ranges: np.ndarray) -> list[np.ndarray]:
        """For ranges of documents and, in each, a cell per row: the cells one level down, for each half."""
        shift = (self.height - 1 - levels).astype(np.int32)
        quarter = cells * 4 + ((rows >> shift[:, None]) & 1) * 2
        column = self.column[cells]
        where, term = np.nonzero(column >= 0)
        half_of = (column[where, term] >> shift[where]) - 2 * ranges[where]  # an end goes down by itself
        out = []
        for half in (0, 1):
            below = self.down[quarter + half]
            stays = half_of == half
            below[where[stays], term[stays]] = cells[where[stays], term[stays]]
            out.append(self.of_rows(below, rows))
        return out

    def best(
        self, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int, known: list[tuple[int, int]]
    ) -> list[tuple[int, int]]:
        """The k best (-score, doc_id) among `known` (sorted) and this shard."""
        best = list(known)
        if not len(self.masks) or not len(rows):
            return best
        rows = rows.astype(np.int32)

        # The open ranges: bound, level, number at that level, and the cell of each row.
        cells = self.descended(rows)[None]
        bounds, levels, ranges = self.most[cells] @ weights, np.full(1, self.parting, np.int32), np.zeros(1, np.int32)
        while len(bounds):
            taken = np.argpartition(-bounds, STEP)[:STEP] if len(bounds) > STEP else np.arange(len(bounds))
            left = np.ones(len(bounds), bool)
            left[taken] = False
            halves = self.halves(cells[taken], rows, levels[taken], ranges[taken])
            below = np.concatenate([cells[left], *halves])
            levels = np.concatenate([levels[left], *[levels[taken] + 1] * 2])
            ranges = np.concatenate([ranges[left], 2 * ranges[taken], 2 * ranges[taken] + 1])
            bounds = np.concatenate([bounds[left], *[self.most[h] @ weights for h in halves]])
            scored = (levels == self.height) & (bounds > 0)  # one document: the bound is its score
            if scored.any():
                found = zip((-bounds[scored]).tolist(), ids[ranges[scored]].tolist(), strict=True)
                best = heapq.nsmallest(k, [*best, *found])
            keep = (bounds > 0) & (levels < self.height)
            if len(best) == k:  # what cannot beat the last of the best, documents rising among equal scores
                score, after = -best[-1][0], int(np.searchsorted(ids, best[-1][1], "right"))
                low = ranges << (self.height - levels)
                keep &= (bounds > score) | ((bounds == score) & (low < after))
            cells, levels, ranges, bounds = below[keep], levels[keep], ranges[keep], bounds[keep]
        return best


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Document numbers and terms of all words of the texts (an array of its own, not a slice), in order."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer((data.to_pybytes() if data else b"").translate(FOLD))
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, folded]))
    words = split.flatten()
    docs = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(split)))
    some = pc.greater(pc.binary_length(words), 0)
    return docs[np.asarray(some)], words.filter(some)


def term_counts(texts: pa.Array) -> np.ndarray:
    """How many terms each text holds."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = IN_TERM[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = ends[:-1][np.diff(ends) > 0]  # a term may begin where the text before it has ended with one
    begins[firsts] = inside[firsts]
    return np.diff(np.searchsorted(np.flatnonzero(begins), ends))


def shard(ids: list[int | None], texts: pa.Array, n_docs: int, n_terms: int) -> dict:
    """One row of the index."""
    order = sorted(range(len(ids)), key=lambda i: NO_ID if ids[i] is None else ids[i])
    docs, words = words_of(texts.take(pa.array(order)))
    coded = words.dictionary_encode()
    spelt, code = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
    lengths = np.bincount(docs, minlength=len(order)).astype(np.int64)
    pairs, tf = np.unique(docs * max(len(spelt), 1) + code, return_counts=True)
    columns, terms = np.divmod(pairs, max(len(spelt), 1))
    df = np.bincount(terms, minlength=len(spelt))
    # Frequent terms take the first rows: their cells lie close together.
    by_df = np.argsort(-df, kind="stable")
    row_of = np.empty(len(spelt), np.int64)
    row_of[by_df] = np.arange(len(spelt))
    impact = impacts(tf.astype(np.int64), lengths[columns], n_docs, n_terms)
    tree = Treap.build(row_of[terms], columns, impact)
    return {
        "ids": [ids[i] for i in order],
        "terms": b"\n".join(spelt.take(pa.array(by_df)).cast(pa.large_binary()).to_pylist()),
        "df": df[by_df].astype("<u4").tobytes(),
        "height": tree.height,
        "masks": tree.masks.tobytes(),
        "maxima": tree.maxima.astype("<i4").tobytes(),  # an impact is at most a million
        "end_rows": tree.end_rows.astype("<i4").tobytes(),
        "end_columns": tree.end_columns.astype("<i4").tobytes(),
    }


INDEX_ARROW = pa.schema(
    [
        ("ids", pa.list_(pa.int64())),
        ("terms", pa.binary()),  # one after the other, by lines
        ("df", pa.binary()),
        ("height", pa.int32()),
        *[(c, pa.binary()) for c in ("masks", "maxima", "end_rows", "end_columns")],
    ]
)


def build_index(docs: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """The index of all documents, written under `folder`, and how many of them hold a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = term_counts(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"docs": [int(np.count_nonzero(n))], "terms": [int(n.sum())]})

    counted = docs.select("text").mapInArrow(count, "docs long, terms long")
    stats = counted.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = stats["docs"] or 0, stats["terms"] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            row = shard(ids, pa.chunked_array(texts, pa.large_string()).combine_chunks(), n_docs, n_terms)
            return pa.RecordBatch.from_pylist([row], INDEX_ARROW)

        for batch in batches:
            column = batch.column("text").cast(pa.large_string())
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            names, first = batch.column("id").to_pylist(), 0
            for i, one in enumerate(sizes):
                if size and size + one > SHARD_BYTES:
                    texts.append(column.slice(first, i - first))
                    ids.extend(names[first:i])
                    yield close()
                    ids, texts, size, first = [], [], 0, i
                size += one
            texts.append(column.slice(first))
            ids.extend(names[first:])
        if ids:
            yield close()
        pa.default_memory_pool().release_unused()  # the worker stays and serves other tasks

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(build, INDEX)
    return staged(rows, folder, "index", **ROW_GROUPS), n_docs


def document_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) of the given terms that occur: the counts of all shards added up."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist(), strict=True):
                counted = pa.array(np.frombuffer(df, "<u4").astype(np.int64))
                spelt = pa.array(words.split(b"\n") if words else [], pa.binary())
                yield pa.RecordBatch.from_arrays([spelt.cast(pa.string()), counted], ["term", "df"])

    local = index.select("terms", "df").mapInArrow(counts, "term string, df long")
    return local.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


def weighted_items(items: DataFrame, index: DataFrame, n_docs: int, folder: str) -> DataFrame:
    """One row per item: its key, id, terms that occur and their weights times their counts."""
    found = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({TERM})"), 1)
    keyed = items.select("item_id", F.sha2("text", 256).alias("key"), F.explode(found).alias("term"))
    terms = staged(keyed.groupBy("item_id", "key", "term").agg(F.count("*").alias("n")), folder, "item-terms")
    # Rows of one id and text count once: their terms were counted together.
    copies = items.groupBy("item_id", F.sha2("text", 256).alias("key")).agg(F.count("*").alias("copies"))
    same = [F.col("a.item_id").eqNullSafe(F.col("b.item_id")), F.col("a.key") == F.col("b.key")]
    once = terms.alias("a").join(copies.alias("b"), same).select("a.*", (F.col("n") / F.col("copies")).cast("long").alias("times"))
    weighted = once.join(document_counts(index, terms), "term").withColumn("w", weight(n_docs, F.col("df")) * F.col("times"))
    grouped = weighted.groupBy("item_id", "key").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    return staged(grouped, folder, "items")


@dataclass
class Block:
    """Items as arrays: the terms and weights of all, those of one item side by side from `starts` on."""

    ids: list[int | None]
    keys: list[str]
    starts: np.ndarray
    terms: pa.Array
    weights: np.ndarray

    @classmethod
    def of(cls, items: pa.Array) -> Block:
        """From the list of (item_id, key, terms) in a row."""
        ids, keys, lists = items.flatten().flatten()
        terms, weights = lists.flatten().flatten()
        starts = np.append(0, np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64)))
        return cls(ids.to_pylist(), keys.to_pylist(), starts, terms.cast(pa.binary()), np.asarray(weights))

    def rows(self, spelt: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each item that has any of a shard's terms: its number, the rows of its terms, their weights."""
        rows = np.asarray(pc.fill_null(pc.index_in(self.terms, value_set=spelt), -1))
        there = (rows >= 0) & (self.weights > 0)
        for q in range(len(self.ids)):
            own = slice(self.starts[q], self.starts[q + 1])
            if there[own].any():
                yield q, rows[own][there[own]], self.weights[own][there[own]]


def search(index: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k best documents in each task for each item of one block: (item_id, key, doc_id, score)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Block | None = None
        best: list[list[tuple[int, int]]] = []
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                if asked is None:  # every row of a task carries the same block
                    asked = Block.of(part.column("items"))
                    best = [[] for _ in asked.ids]
                masks, *three = (part.column(c)[0].as_buffer() for c in ("masks", "maxima", "end_rows", "end_columns"))
                ids = np.asarray(pc.fill_null(part.column("ids").flatten(), NO_ID))
                tree = Treap(part.column("height")[0].as_py(), np.frombuffer(masks, np.uint8), *(np.frombuffer(b, "<i4") for b in three))
                for q, rows, weights in asked.rows(pc.split_pattern(part.column("terms").cast(pa.binary()), b"\n").flatten()):
                    best[q] = tree.best(rows, weights, ids, k, best[q])
        ranked = zip(asked.ids, asked.keys, best, strict=True) if asked else ()
        found = [(i, key, None if d == NO_ID else d, -s) for i, key, b in ranked for s, d in b]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item_id", "key", "doc_id", "score"]
        )

    block = items.groupBy().agg(F.collect_list(F.struct("item_id", "key", "terms")).alias("items")).withColumn("block", F.lit(0))
    # The block is bounded by BLOCK_BYTES before it is sent to all tasks.
    rows = index.drop("df").withColumn("block", F.lit(0)).join(F.broadcast(block), "block").drop("block")
    return rows.mapInArrow(run, "item_id long, key string, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k highest-scoring documents of every item: item_id, rank, doc_id, score."""
    folder = shared_folder(docs.sparkSession)
    with small_batches(docs.sparkSession):
        index, n_docs = build_index(docs, folder)
        named = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
        ready = weighted_items(named, index, n_docs, folder)
        size = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.length(t["term"]) + 16)
        total = ready.agg(F.sum(size)).first()[0] or 0
        blocks = -(-total // BLOCK_BYTES) or 1
        dealt = ready.withColumn("part", F.pmod(F.xxhash64("item_id", "key"), F.lit(blocks)))
        for b in range(blocks):
            staged(search(index, dealt.filter(F.col("part") == b), k), folder, f"found/part={b}")
    found = docs.sparkSession.read.schema("item_id long, key string, doc_id long, score long").parquet(f"{folder}/found")
    first = Window.partitionBy("item_id", "key").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
