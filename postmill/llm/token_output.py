"""Token ids on disk: frequency-ranked ids in byte-aligned variable-length coding.

Every document is tokenized once, closed with an end id and written in ascending doc_id order. An id
is stored as its frequency rank over the whole corpus in the fewest of 1 to 4 bytes; the lengths
sit apart, four to a control byte. A reader looks each control byte up in a table of lengths and
gathers the bytes with numpy, without a loop over ids.

Layout: `<path>/ranks` (rank, id) and `<path>/docs`: shard (a range of doc_ids, ascending), doc_id,
start (ids before it in its shard), n_ids, control, data. Documents decode independently of each other.

The tokenizer splits at white space, so a worker tokenizes each distinct word once while it remembers it. The
texts of a chunk are split and their distinct words found by Arrow; numpy puts the ids of the words in a row.
A text that names a special token (`<|endoftext|>`) is left whole to the library, which gives it that token's id.

Edge cases: a null or empty text is the end id alone; null doc_ids come first; repeated doc_ids are
kept as they are, ordered by their ids; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm.common import bytes_of, staged, text_chunks

#: Distinct words a worker remembers; beyond it the memory starts afresh.
WORDS_KEPT = 1_500_000

#: New words tokenized in one call.
CALL_WORDS = 5_000

#: Bytes of text whose distinct words are looked up together, and words whose ids are put in a row at once.
ENCODE_BYTES, GATHER_WORDS = 4 << 20, 1 << 18

# The tokenizer composes marks before it lower-cases, and some compose with small letters alone (T + U+0308
# does not, t + U+0308 does). All marks that compose with A-Z lie in U+0300 to U+036F, and have these first bytes.
MARKS = (b"\xcc", b"\xcd")

# Up to here characters compose with nothing after them, and all libraries agree on letters and digits.
LATIN_END = "\u0250"

#: The characters up to there that are shown, and in lower case.
PLAIN = frozenset(c for c in map(chr, range(ord(LATIN_END))) if c.isprintable() and c == c.lower())

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

DOCS = "shard int, doc_id long, start long, n_ids long, control binary, data binary"

#: For each control byte the lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def widths(values: np.ndarray) -> np.ndarray:
    """The bytes that each value takes."""
    return 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)


def places(counts: np.ndarray) -> np.ndarray | slice:
    """Where the values of runs come to lie when every run begins at a multiple of four."""
    if len(counts) == 1:
        return slice(int(counts[0]))
    room = -(-counts // 4) * 4
    return np.arange(counts.sum()) + np.repeat(np.cumsum(room - counts) - (room - counts), counts)


def pack(values: np.ndarray, counts: np.ndarray | int | None = None) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values, or of runs of so many values each."""
    v = np.ascontiguousarray(values, dtype="<u4")
    counts = np.atleast_1d(len(v) if counts is None else counts)
    lengths = widths(v)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    codes = np.zeros(int((-(-counts // 4) * 4).sum()), np.uint8)
    codes[places(counts)] = lengths - 1
    control = codes[::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, counts: np.ndarray | int) -> np.ndarray:
    """The values again."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[places(np.atleast_1d(counts))]
    out = np.zeros((len(lengths), 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def joined(column: pa.Array) -> bytes:
    """All values of a binary column, one after the other."""
    return b"".join(column.to_pylist())


def sliced(data: bytes, ends: np.ndarray) -> list[bytes]:
    """The parts of `data` up to each of the ends."""
    stops = ends.tolist()
    return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]


def piece_rule(tokenizer: dict):
    """The pattern of the pieces that a tokenizer's words are cut into, and the end that marks a piece's last token.

    (None, None) for a tokenizer that does not keep just the matches of one pattern and mark their ends.
    """
    steps = (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers") or [tokenizer.get("pre_tokenizer") or {}]
    suffix, first = (tokenizer.get("model") or {}).get("end_of_word_suffix"), steps[0]
    keeps = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    cuts_no_more = all(s.get("type") == "ByteLevel" and not s.get("use_regex") for s in steps[1:])
    if not (suffix and keeps and cuts_no_more and "Regex" in first["pattern"]):
        return None, None
    import regex

    return regex.compile(first["pattern"]["Regex"]), suffix


class Runs:
    """Strings, numbered as they come, and the ids of each, end to end in one array."""

    def __init__(self, unit: str):
        self.number: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, unit), np.zeros(1, np.int64)

    def add(self, keys: list[str], ids: list[np.ndarray], lengths: list[np.ndarray]) -> None:
        """New keys, their ids in a row, and how many each has, both in any number of arrays."""
        self.number.update(zip(keys, range(len(self.number), len(self.number) + len(keys)), strict=True))
        self.flat = np.concatenate([self.flat, *ids])
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.concatenate([self.ends[:0], *lengths])))

    def numbers(self, keys: list[str]) -> np.ndarray:
        """The numbers of keys, -1 for unknown ones."""
        return np.fromiter(map(self.number.get, keys, repeat(-1)), np.int32, len(keys))

    def row(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these strings in a row, and where those of each end."""
        starts, lengths = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat(starts - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.flat[at], ends


class WordCoder:
    """Ids of texts, word by word, with a memory of the words met. `unit` is the type of an id."""

    def __init__(self, tokenizer_file: str, fold_case: bool, unit: str = "<u4"):
        self.fold, self.unit = LOWER if fold_case else None, unit
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # A special token between words keeps the words of one call apart.
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark = min(special, default=None)
        self.specials = tuple(content.lower().encode() for _, content in special)
        self.pattern, suffix = piece_rule(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.pieces = Runs(self.unit), Runs(self.unit)
        self.known.add([""], [], [np.zeros(1, np.int64)])  # beside leading and trailing white space

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.unit)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, from those of the pieces that the tokenizer cuts them into, each tokenized once."""
        cut = [w for w in words if PLAIN.issuperset(w)] if self.pattern else []
        parts = self.pattern.findall(" ".join(cut)) if cut else []
        if "".join(parts) != "".join(cut):
            cut = []  # a pattern that leaves characters out, or takes white space
        self._learn_whole(list(set(words).difference(cut)))
        if not cut:
            return
        new, found, lengths = list(set(parts).difference(self.pieces.number)), [], []
        for k in range(0, len(new), CALL_WORDS):
            part = new[k : k + CALL_WORDS]
            ids = self._ids(" ".join(part))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer cuts pieces that its own pattern leaves whole")
            found.append(ids)
            lengths.append(np.diff(ends, prepend=0))
        self.pieces.add(new, found, lengths)
        flat, ends = self.pieces.row(self.pieces.numbers(parts))
        stops = [np.cumsum(np.fromiter(map(len, s), np.int64, len(s))) for s in (parts, cut)]
        self.known.add(cut, [flat], [np.diff(ends[np.searchsorted(*stops)], prepend=0)])

    def _learn_whole(self, words: list[str]) -> None:
        found, lengths = [], []
        if self.mark is None:
            found = [self._ids(w) for w in words]
            lengths = [np.array([len(ids)]) for ids in found]
        else:
            for k in range(0, len(words), CALL_WORDS):
                ids = self._ids(self.mark[1].join(words[k : k + CALL_WORDS]))
                marks = np.flatnonzero(ids == self.mark[0])
                found.append(np.delete(ids, marks))
                lengths.append(np.diff(marks, prepend=-1, append=len(ids)) - 1)
        self.known.add(words, found, lengths)

    def _folded(self, text: bytes) -> bytes | None:
        """The text with its words as they are looked up, in lower case where the tokenizer would come to the same
        ids; None for a text that may name a special token."""
        folded = text.translate(LOWER)
        if any(s in folded for s in self.specials):
            return None
        if self.fold is None:
            return text
        if any(m in text for m in MARKS):
            return b" ".join([w.translate(LOWER) if w.isascii() else w for w in text.split()])
        return folded

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of UTF-8 texts."""
        if len(self.known.number) > WORDS_KEPT:
            self._forget()
        split = pc.ascii_split_whitespace(pa.array([self._folded(t) for t in texts], pa.string()))
        met = split.values.dictionary_encode()
        words = met.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = self.known.numbers(words)
        new = np.flatnonzero(number < 0)
        if len(new):
            learnt = [words[i] for i in new]
            self._learn(learnt)
            number[new] = self.known.numbers(learnt)
        occurring = number[met.indices.to_numpy()]
        flat, word_ends = [], np.zeros(len(occurring) + 1, np.int64)
        for k in range(0, len(occurring), GATHER_WORDS):
            ids, ends = self.known.row(occurring[k : k + GATHER_WORDS])
            flat.append(ids.tobytes())
            word_ends[k + 1 : k + 1 + len(ends)] = word_ends[k] + ends
        text_ends = word_ends[split.offsets.to_numpy()[1:]] * self.known.flat.itemsize
        ids = sliced(b"".join(flat), text_ends)
        for k in np.flatnonzero(split.is_null().to_numpy(zero_copy_only=False)):
            ids[k] = self._ids(texts[k].decode()).tobytes()
        return ids


@lru_cache(maxsize=2)
def coder(tokenizer_file: str, fold_case: bool, unit: str) -> WordCoder:
    """The coder of this process."""
    return WordCoder(tokenizer_file, fold_case, unit)


def id_type(tokenizer_file: str) -> str:
    """The narrowest type that holds every id."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, tokenizer_file: str, end_id: int, fold_case: bool = False) -> DataFrame:
    """doc_id and ids with the end id (binary, in the type of `id_type`) of every document.

    `fold_case` says that the tokenizer lower-cases, so that words may be met in lower case.
    """
    unit = id_type(tokenizer_file)
    end = np.array([end_id], unit).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(tokenizer_file, fold_case, unit)
        for chunk in text_chunks(batches, limit=ENCODE_BYTES):
            ids = [i + end for i in words.encode(bytes_of(chunk))]
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id"), "ids": pa.array(ids, pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def id_counts(coded: DataFrame, unit: str) -> DataFrame:
    """How often each id occurs: (id, n), counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                ids = np.frombuffer(b"".join(batch.column("ids").slice(k, 500).to_pylist()), unit)
                here = np.bincount(ids, minlength=len(total))
                here[: len(total)] += total
                total = here
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(found, pa.int64()), "n": pa.array(total[found], pa.int64())})

    return coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, fold_case: bool = False) -> None:
    """Write all documents' ids under `path`. The rank table is as large as the vocabulary."""
    spark, unit = docs.sparkSession, id_type(tokenizer_file)
    coded = staged(tokenized(docs, tokenizer_file, end_id, fold_case), path, "tokenized")
    ranked = id_counts(coded, unit).orderBy(F.desc("n"), "id").toPandas()["id"].to_numpy()
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(ranked)], "rank int, id long").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/ranks")
    rank_of = np.zeros(int(ranked.max(initial=0)) + 1, "<u4")
    rank_of[ranked] = np.arange(len(ranked))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for chunk in text_chunks(batches, "ids"):
            values = rank_of[np.frombuffer(joined(chunk.column("ids")), unit)]
            n = pc.binary_length(chunk.column("ids")).to_numpy().astype(np.int64) // np.dtype(unit).itemsize
            ends = np.cumsum(n)
            control, data = pack(values, n)
            data_ends = np.cumsum(widths(values), dtype=np.int64)[ends - 1]  # no document is without its end id
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array(np.full(len(n), shard), pa.int32()),
                    "doc_id": chunk.column("doc_id"),
                    "start": pa.array(start + ends - n, pa.int64()),
                    "n_ids": pa.array(n, pa.int64()),
                    "control": pa.array(sliced(control, np.cumsum(-(-n // 4))), pa.binary()),
                    "data": pa.array(sliced(data, data_ends), pa.binary()),
                }
            )
            start += int(ends[-1])

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartitionByRange(shards, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(packed, DOCS).write.mode("overwrite").parquet(f"{path}/docs")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document read from the files: doc_id, start, n_tokens, ids_crc32, ids (binary)."""
    ranks = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")["id"].to_numpy().astype("<u4")
    files = spark.read.schema(DOCS).parquet(f"{path}/docs")
    names = ["shard", "doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "data"):
            n = chunk.column("n_ids").to_numpy()
            values = unpack(joined(chunk.column("control")), joined(chunk.column("data")), n)
            ids = sliced(ranks[values].tobytes(), 4 * np.cumsum(n))
            columns = [chunk.column(c) for c in ("shard", "doc_id", "start", "n_ids")]
            columns += [pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    docs = files.mapInArrow(decode, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    # One row per shard, as many as the writer's partitions: small by construction.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return docs.join(F.broadcast(starts), "shard").select(
        "doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )
