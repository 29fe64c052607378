"""Benchmark passages in documents, found by counting q-grams in diagonal bands.

Benchmark items are cut into overlapping probes of 100 normalised characters (lower case, every run
of other characters than letters and digits one blank); a document is contaminated by an item if
it holds one of its probes within an edit budget of 8 %. By the q-gram lemma such a place shares at
least w + 1 - q (e + 1) q-grams with the probe, on at most e + 1 neighbouring diagonals. So a task
looks every q-gram of a text up among the probes', counts hits by probe and overlapping diagonal
band, and aligns only the bands that reach the bound, with a banded dynamic program over all
of them at once. No place within the budget is missed.

The benchmark is shipped to the tasks in blocks of at most `BLOCK_CHARS` characters, one pass over the
documents each; documents are never shuffled.

An item of fewer than 40 normalised characters has no room for edits: it is found where it stands letter for
letter between word bounds, by one automaton over all such items.

Hits are counted slice by slice of a text and a band is closed when the text has passed it, so a q-gram that
all probes share costs time and no memory.

Edge cases: null or empty texts on either side match nothing; repeated documents and equal items each
give their rows; an empty table on either side gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import text_chunks, texts_of

Q = 10
PROBE, STRIDE = 100, 50
EDITS_PERCENT = 8
LEAST_CHARS = 40
BLOCK_CHARS = 4_000_000

#: Hits that are expanded at a time.
SLICE_HITS = 1 << 21

#: Diagonals a band advances by; bands are twice as wide. More than the edits of a probe.
BAND = 16

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
GAP = 0x110000  # between two documents: no character
FOUND = "doc_id {}, item_id long, distance int, start long, end long, n_probes long"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower case, or a blank if it is no letter or digit."""
    out = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalnum():
            out[c] = ord(ch.lower()[0])
    return out


def normalised(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points and where each stood. `GAP` and code points above the basic plane stay."""
    table = _letters()
    low = np.where(text < 0x10000, table[np.minimum(text, 0xFFFF)], text)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    places = np.flatnonzero(keep)
    return low[places], places


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def qgrams(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram that begins at each place."""
    h, span, done = text.astype(np.uint64) + np.uint64(1), 1, None
    at, rest = 0, Q
    while rest:  # the binary digits of Q name the spans to put together
        if rest & 1:
            done = h if done is None else done[: len(h) - at] * (MULTIPLIER + np.uint64(2 * span)) + h[at:]
            at += span
        rest >>= 1
        if rest:
            h = h[: max(0, len(h) - span)] * (MULTIPLIER + np.uint64(2 * span + 1)) + h[span:]
            h ^= h >> np.uint64(31)
            span *= 2
    return done[: max(0, len(text) - Q + 1)]


def spelt(text: np.ndarray) -> str:
    """Code points as a string; `GAP` as the character 0, which no normalised text holds."""
    return np.where(text == GAP, 0, text).astype("<u4").tobytes().decode("utf-32-le", "replace")


class Probes:
    """The probes of some items and the index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.text, self.edits, self.need = [], [], [], []
        self.short: dict[str, list[int]] = {}  # items that are searched letter for letter
        grams, of, place = [], [], []
        for item_id, raw in items:
            text = normalised(points(raw or ""))[0]
            text = text[int(len(text) > 0 and text[0] == 32) : len(text) - int(len(text) > 1 and text[-1] == 32)]
            if len(text) < LEAST_CHARS:
                if len(text) and text.tolist() != [32]:
                    self.short.setdefault(spelt(text), []).append(item_id)
                continue
            for at in sorted({*range(0, max(1, len(text) - PROBE + 1), STRIDE), max(0, len(text) - PROBE)}):
                probe = text[at : at + PROBE]
                edits = min(len(probe) * EDITS_PERCENT // 100, len(probe) // Q - 1, BAND - 1)
                own = qgrams(probe)
                grams.append(own)
                of.append(np.full(len(own), len(self.item)))
                place.append(np.arange(len(own)))
                self.item.append(item_id)
                self.text.append(probe)
                self.edits.append(edits)
                self.need.append(len(probe) + 1 - Q * (edits + 1))
        self.edits, self.need = np.array(self.edits, np.int64), np.array(self.need, np.int64)
        flat = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.of = np.concatenate([*of, np.empty(0, int)])[order]
        self.place = np.concatenate([*place, np.empty(0, int)])[order]
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = 22
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self._slot(self.grams)] = True
        self.automaton = None
        if self.short:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for words, ids in self.short.items():
                self.automaton.add_word(words, (len(words), ids))
            self.automaton.make_automaton()

    def exact(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of every short item between word bounds of normalised text."""
        if self.automaton is None:
            return []
        line = spelt(text)
        bounds = " \x00"
        return [
            (item, last + 1 - size, last + 1)
            for last, (size, ids) in self.automaton.iter(line)
            if (last + 1 == size or line[last - size] in bounds) and (last + 1 == len(line) or line[last + 1] in bounds)
            for item in ids
        ]

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def bands(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, band) of the diagonal bands that hold as many shared q-grams as the lemma asks for."""
        grams = qgrams(text)
        near = np.flatnonzero(self.maybe[self._slot(grams)])
        at = np.minimum(np.searchsorted(self.grams, grams[near]), len(self.grams) - 1)
        same = self.grams[at] == grams[near]
        near, at = near[same], at[same]
        total = np.cumsum(self.count[at])
        offset, span = 1 << 40, np.int64(1) << 41
        keys, counts, found, done = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        while done < len(near):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + SLICE_HITS, "right")))
            place, gram = near[done:upto], at[done:upto]
            n = self.count[gram]
            each = np.repeat(self.first[gram], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            probe, diagonal = self.of[each], np.repeat(place, n) - self.place[each]
            here = probe * span + diagonal // BAND + offset
            more, extra = np.unique(np.concatenate([here, here - 1]), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, more]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, extra]), len(keys)).astype(np.int64)
            # Later places lie on later diagonals, but for the length of a probe.
            done = upto
            passed = (int(near[done]) - PROBE) // BAND - 1 + offset if done < len(near) else int(span)
            closed = keys % span < passed
            full = closed & (counts >= self.need[keys // span])
            found.append(keys[full])
            keys, counts = keys[~closed], counts[~closed]
        full = np.concatenate([np.empty(0, np.int64), *found])
        return full // span, full % span - offset

    def align(self, text: np.ndarray, probe: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each probe inside its band of diagonals, and where that alignment ends."""
        lengths = np.array([len(self.text[p]) for p in probe])
        longest, low = int(lengths.max()), band * BAND
        letters = np.full((len(probe), longest), GAP + 1, np.uint32)
        for r, p in enumerate(probe):
            letters[r, : lengths[r]] = self.text[p]
        padded = np.concatenate([np.full(2 * BAND, GAP, np.uint32), text, np.full(longest + 4 * BAND, GAP, np.uint32)])
        k = np.arange(2 * BAND)
        cost = np.zeros((len(probe), 2 * BAND), np.int32)
        final, ends = np.full(len(probe), 1 << 20, np.int32), np.zeros(len(probe), np.int64)
        for i in range(longest):
            there = padded[np.clip(low[:, None] + k + i + 2 * BAND, 0, len(padded) - 1)]
            step = cost + (there != letters[:, i : i + 1])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - k, axis=1).astype(np.int32) + k.astype(np.int32)
            over = np.flatnonzero(lengths == i + 1)
            if len(over):
                best = cost[over].argmin(1)
                final[over], ends[over] = cost[over, best], low[over] + best + i + 1
        return final, ends

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probe, edits, end) of every probe within its budget in normalised text, once per band."""
        none = np.empty(0, np.int64)
        if not len(self.item) or len(text) < Q:
            return none, none, none
        probe, band = self.bands(text)
        out = []
        for a in range(0, len(probe), 4096):
            p, b = probe[a : a + 4096], band[a : a + 4096]
            edits, ends = self.align(text, p, b)
            ok = edits <= self.edits[p]
            out.append((p[ok], edits[ok].astype(np.int64), ends[ok]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


def _matches(docs: DataFrame, items: list[tuple[int, str]], id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = Probes(items)
        owner, length = np.array(probes.item, np.int64), np.array([len(t) for t in probes.text], np.int64)
        for chunk in text_chunks(batches):
            ids, parts = chunk.column("doc_id").to_pylist(), [points(t) for t in texts_of(chunk)]
            gap = np.array([GAP], np.uint32)
            raw = np.concatenate([x for p in parts for x in (p, gap)])
            begins = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
            text, places = normalised(raw)
            probe, edits, ends = probes.search(text)
            # The last character tells the document and where the passage ends; the start is as far back as the probe is long.
            last = places[np.clip(ends - 1, 0, max(0, len(places) - 1))]
            first = places[np.clip(ends - length[probe], 0, max(0, len(places) - 1))]
            doc = np.searchsorted(begins, last, "right") - 1
            best: dict[tuple[int, int], list] = {}
            rows = zip(doc.tolist(), owner[probe].tolist(), probe.tolist(), edits.tolist(), first.tolist(), last.tolist(), strict=True)
            for d, item, p, e, a, z in rows:
                a, z = max(0, a - int(begins[d])), z - int(begins[d]) + 1
                known = best.setdefault((d, item), [e, a, z, set()])
                known[:3] = [min(known[0], e), min(known[1], a), max(known[2], z)]
                known[3].add(p)
            for item, a, z in probes.exact(text):
                a, z = int(places[a]), int(places[z - 1]) + 1
                d = int(np.searchsorted(begins, a, "right")) - 1
                a, z = a - int(begins[d]), z - int(begins[d])
                known = best.setdefault((d, item), [0, a, z, set()])
                known[:3] = [0, min(known[1], a), max(known[2], z)]
                known[3].add(-1)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[d] for d, _ in best], pa.int64() if id_type == "long" else pa.string()),
                    "item_id": pa.array([i for _, i in best], pa.int64()),
                    "distance": pa.array([v[0] for v in best.values()], pa.int32()),
                    "start": pa.array([v[1] for v in best.values()], pa.int64()),
                    "end": pa.array([v[2] for v in best.values()], pa.int64()),
                    "n_probes": pa.array([len(v[3]) for v in best.values()], pa.int64()),
                }
            )

    return docs.select(F.col("doc_id").cast(id_type), "text").mapInArrow(run, FOUND.format(id_type))


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of at most `BLOCK_CHARS` characters and at least one item."""
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.coalesce(text, F.lit("")).alias("text"))
    block: list[tuple[int, str]] = []
    taken = 0
    for row in items.toLocalIterator():
        if block and taken + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, taken = [], 0
        block.append((row["item"], row["text"]))
        taken += len(row["text"])
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per document and item it holds: least distance, start and end in the text, probes found.

    `id_type` is the type of the documents' ids, long or string.
    """
    found = [_matches(docs, block, id_type) for block in item_blocks(benchmark)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], FOUND.format(id_type))
