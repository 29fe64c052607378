"""License notices in texts, misspelt ones included.

Texts become their words, A-Z in lower case, joined by single spaces. A notice of n characters may differ
by a bounded number k of edits. Cut into k + 1 pieces, one piece at least must stand unchanged in such a
place (k edits cannot touch them all), so one automaton over all pieces finds every candidate. Around each,
the regex library's bounded-error matching verifies the runs of whole words; the one with the fewest edits
counts. Of matches that overlap, the one with the smaller share of edits stays.

Base places are exact: the words of a base phrase standing one after the other; the same automaton finds them.

Edge cases: a null or empty text has no words, no labels and score 0. Texts of any length are searched
whole; the work at a place is bounded, so many places cost in proportion to their number. Repeated rows are
answered each; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bytes_of, text_chunks

#: Phrases whose exact places are counted, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Short notices in the form of the words that are searched, and their labels.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
)

#: Characters of a notice for each edit that is allowed.
CHARS_PER_EDIT = 15

#: Separators become spaces and A-Z small letters; digits, letters and all beyond ASCII are words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def budget(notice: str) -> int:
    """Edits that a notice may show."""
    return max(1, len(notice) // CHARS_PER_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice cut into one piece more than it may have edits: (start, piece)."""
    n = budget(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Match:
    """A notice found: its number, its first and last word, and its edits."""

    notice: int
    first: int
    last: int
    edits: int


class Scanner:
    """The automaton of all pieces and phrases, and a fuzzy pattern per notice."""

    def __init__(self, base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]):
        import ahocorasick
        import regex

        self.base, self.notices = base, notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (phrase, _) in enumerate(base):
            seeds.setdefault(f" {phrase} ", []).append((-1, k))
        for k, (_, notice) in enumerate(notices):
            for at, piece in pieces(notice):
                seeds.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={budget(n)}}}") for _, n in notices]

    def places(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Base places (position, phrase) and matches (notice, start, end, edits) in ' word word '."""
        exact: list[tuple[int, int]] = []
        starts: dict[int, set[int]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for notice, at in uses:
                if notice < 0:
                    exact.append((end - size + 2, at))
                else:
                    starts.setdefault(notice, set()).add(end - size + 1 - at)
        found = []
        for notice, implied in starts.items():
            k = budget(self.notices[notice][1])
            ordered, i = sorted(implied), 0
            while i < len(ordered):
                first = last = ordered[i]  # starts that edits shift a little are one candidate
                while i < len(ordered) and ordered[i] <= first + k:
                    last, i = ordered[i], i + 1
                best = self._verified(notice, text, first - k, last + k)
                if best and (not found or best != found[-1]):
                    found.append(best)
        return sorted(exact), found

    def _verified(self, notice: int, text: str, low: int, high: int) -> tuple[int, int, int, int] | None:
        """Of the runs of whole words that start from low to high, the match with the fewest edits."""
        size, k = len(self.notices[notice][1]), budget(self.notices[notice][1])
        best = None
        for a in range(max(low, 1), min(high + 1, len(text))):
            if text[a - 1] == " " != text[a]:
                for b in range(max(a + size - k, a + 1), min(a + size + k + 1, len(text))):
                    if text[b] == " " != text[b - 1] and (m := self.patterns[notice].fullmatch(text, a, b)):
                        edits = sum(m.fuzzy_counts)
                        if best is None or edits < best[3]:
                            best = (notice, a, b, edits)
        return best

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], list[Match]]:
        """Words, base places (first word, phrase) and the notices that stay, in order."""
        words = data.translate(FOLD).split()
        text = f" {b' '.join(words).decode('utf-8', 'replace')} "
        exact, found = self.places(text)
        if not exact and not found:
            return len(words), [], []
        marks = sorted({p for p, _ in exact} | {p for f in found for p in (f[1], f[2])})
        word_at, at, n = {}, 0, -1
        for p in marks:  # the spaces before a place count its words
            n += text.count(" ", at, p)
            at, word_at[p] = p, n
        by_share = sorted(found, key=lambda f: (f[3] / len(self.notices[f[0]][1]), -len(self.notices[f[0]][1]), f[0], f[1]))
        kept = _apart(by_share)
        matches = [Match(k, word_at[a], word_at[b], e) for k, a, b, e in sorted(kept, key=lambda f: f[1])]
        return len(words), [(word_at[p], k) for p, k in exact], matches


def _apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Matches taken in order, each if it overlaps none before it."""
    kept: list[tuple[int, int, int, int]] = []
    starts: list[int] = []
    spans: list[tuple[int, int]] = []
    for f in found:
        i = bisect.bisect_right(starts, f[1])
        if (i and spans[i - 1][1] > f[1]) or (i < len(spans) and spans[i][0] < f[2]):
            continue
        starts.insert(i, f[1])
        spans.insert(i, (f[1], f[2]))
        kept.append(f)
    return kept


@lru_cache(maxsize=2)
def scanner(base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> Scanner:
    """The scanner of this process."""
    return Scanner(base, notices)


def offsets(text: str, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """Where the wanted words stand in the text, in code points."""
    last, out = max(wanted), {}
    for n, m in enumerate(WORD.finditer(text)):
        if n in wanted:
            out[n] = m.span()
        if n == last:
            break
    return out


ROW = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, start: long, end: long, edits: int>>"
)

SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])


def license_scan(docs: DataFrame, base=BASE, notices=NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its words, the base places, the labels, a score (1: exact, less an edit's share of the
    notice for each edit of the best match) and the spans of the notices in the text, in code points."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {ROW}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(base, notices)
        for chunk in text_chunks(batches):
            out: list[tuple] = []
            for data in bytes_of(chunk):
                n_words, exact, found = find.scan(data)
                labels = {base[k][1] for _, k in exact}
                every = labels | {notices[m.notice][0] for m in found}
                firsts = [w for w, _ in exact] or [None]
                shares = [1 - m.edits / len(notices[m.notice][1]) for m in found]
                at = offsets(data.decode("utf-8", "replace"), {w for m in found for w in (m.first, m.last)}) if found else {}
                spans = [
                    {"label": notices[m.notice][0], "start": at[m.first][0], "end": at[m.last][1], "edits": m.edits} for m in found
                ]
                score = 1.0 if exact else max(shares, default=0.0)
                out.append(
                    (n_words, len(exact), firsts[0], firsts[-1], ",".join(sorted(labels)), ",".join(sorted(every)), score, spans)
                )
            types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(SPAN))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([chunk.column("id"), *columns], ["id", *names])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", key)
