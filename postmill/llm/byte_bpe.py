"""Byte-level BPE on whole columns of pieces: padded numpy matrices, one merge a row and round.

A text is cut by the vocabulary's pattern. Pieces that a task has not met before are grouped by
length into padded matrices of ids; each round looks every neighbouring pair up in a hash table,
merges each row's leftmost pair of least rank, closes the gap and drops finished rows. A piece
longer than the widest bucket goes through the same rule with a heap over a linked list, which
costs n log n where the matrix would cost n squared.

Edge cases: a null or empty text has no ids and decodes to no bytes; rows with null or repeated
doc_ids are each encoded; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import text_chunks, texts_of

#: Widths of the matrices; longer pieces take the heap.
BUCKETS = (4, 8, 16, 32, 64, 128, 256)

#: Cells of one matrix at most.
CELLS = 1 << 20

#: Distinct pieces a task remembers; beyond it the memory starts afresh.
PIECES_KEPT = 300_000

NONE = np.int32(2**31 - 1)


class ByteBpe:
    """Encoder and decoder for one rank file (base64 token and rank a line)."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.bytes_to_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[bytes, bytes] = {}
        pairs = {
            (self.ranks[t[:i]] << 32) | self.ranks[t[i:]]: r
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        }
        self._hash(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: whoever finds its slot taken tries the next one."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & ((1 << self.bits) - 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, `NONE` where it is no token; negative ids never pair."""
        shape, keys = left.shape, ((left.astype(np.int64) << 32) | right).reshape(-1)
        out = np.full(len(keys), NONE, np.int32)
        rest = np.flatnonzero((left.reshape(-1) >= 0) & (right.reshape(-1) >= 0))
        slots = self._slots(keys[rest])
        while len(rest):
            there = self.keys[slots]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[slots[hit]]
            on = ~hit & (there != -1)
            rest, slots = rest[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)

    def _matrix(self, pieces: list[bytes], width: int) -> None:
        lengths = np.array([len(p) for p in pieces])
        cells = np.arange(width) < lengths[:, None]
        ids = np.full(cells.shape, -1, np.int32)
        ids[cells] = self.bytes_to_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rows = np.arange(len(pieces))
        while len(rows):
            if ids.shape[1] > 1:
                ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
            else:
                best = np.full(len(rows), NONE)
            done = best == NONE
            for r in np.flatnonzero(done):
                row = ids[r]
                self.known[pieces[rows[r]]] = row[row >= 0].astype("<u4").tobytes()
            if done.all():
                return
            ids, rows, at, best = ids[~done], rows[~done], at[~done], best[~done]
            ids[np.arange(len(rows)), at] = best
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)

    def _long(self, piece: bytes) -> bytes:
        ids = [int(i) for i in self.bytes_to_id[np.frombuffer(piece, np.uint8)]]
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        tokens, ranks = self.tokens, self.ranks

        def rank(i: int) -> int | None:
            j = after[i]
            return None if j < 0 else ranks.get(tokens[ids[i]] + tokens[ids[j]])

        heap = [(r, i) for i in range(len(ids) - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (s := rank(k)) is not None:
                    heapq.heappush(heap, (s, k))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > PIECES_KEPT:
            self.known.clear()
        split = [[p.encode() for p in self.pattern.findall(t)] for t in texts]
        todo: dict[int, list[bytes]] = {}
        for piece in {p for pieces in split for p in pieces}.difference(self.known):
            whole = self.ranks.get(piece)
            if whole is not None:
                self.known[piece] = np.array([whole], "<u4").tobytes()
            elif len(piece) > BUCKETS[-1]:
                self.known[piece] = self._long(piece)
            else:
                todo.setdefault(next(w for w in BUCKETS if w >= len(piece)), []).append(piece)
        for width, pieces in todo.items():
            rows = max(1, CELLS // width)
            for k in range(0, len(pieces), rows):
                self._matrix(pieces[k : k + rows], width)
        known = self.known
        return [np.frombuffer(b"".join([known[p] for p in pieces]), "<u4") for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def coder(rank_file: str, pattern: str) -> ByteBpe:
    """The coder of this process, built once."""
    return ByteBpe(rank_file, pattern)


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(rank_file, pattern)
        for chunk in text_chunks(batches):
            ids = [i.tobytes() for i in bpe.encode(texts_of(chunk))]
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id"), "ids": pa.array(ids, pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def bpe_decode(coded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes they stand for (column `decoded`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(rank_file, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                back = [bpe.decode(np.frombuffer(i, "<u4")) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    return coded.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    both = bpe_decode(bpe_encode(docs, rank_file, pattern), rank_file, pattern)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

