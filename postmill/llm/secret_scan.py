"""Secrets in texts: fixed patterns, and values after credential words judged by their guess cost.

The patterns are taken leftmost and non-overlapping, kind by kind. Besides, every value that follows
a credential word (`pwd`, `login`, `private key` and the like) is cut into dictionary words, dates,
repeats, keyboard walks and brute-force runs by dynamic programming so that the product of the
parts' guesses is least; a value that still costs 10^8 guesses or more is a secret, kind `guess`.
Placeholders such as `changeme` or `aaaaaaaa` and ordinary words cost little and are left alone; so is a
value of letters that reads like words, by a model of three letters in a row learnt from the word list. The search
goes on from the start of a value left alone, as it may be a credential word itself. The words
are those of two public tokenizers, in the order of their merges, which is about that of frequency.

A span is kind:start:end over the whole match, in code points, end exclusive.

Edge cases: a null or empty text has no spans; repeated rows and null doc_ids are scanned each; an
empty table gives no rows; values of any length are judged in time linear in the length. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import text_chunks, texts_of

#: Kinds in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Words that announce a credential beyond those of ASSIGN, then the value. Those that end ordinary words
#: (`spin`, `compass`) start after no letter, or with a capital after a small one.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|api[_-]?key|credentials?|private[_-]?key|access[_-]?key"""
    r"""|(?:(?<![A-Za-z\u00C0-\u024F])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass|pin|secret|token|login|auth))"""
    r"""["']?[ \t]*(?:[:=]|\bis\b)[ \t]*["']?([^\s"'<>]{6,})""",
    re.ASCII | re.IGNORECASE,
)

#: log10 of the guesses from which a value counts as a secret.
LEAST_COST = 8.0

# Frequent words of passwords and placeholders, most frequent first.
WORDS = (
    "password pass word secret token admin user login changeme change me default example test demo sample "
    "your here my the and key api none null true false empty required value string text name mail email "
    "qwerty letmein welcome monkey dragon master shadow sunshine princess football baseball superman batman "
    "iloveyou love hello access root toor guest public private system server data base temp"
).split()

# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")

LEET = str.maketrans("4@310!$57+", "aaeioisstt")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")

STEPS = {(a, b) for row in ROWS for a, b in (*zip(row, row[1:]), *zip(row[1:], row))}

#: Letters of the least word taken from the tokenizers; shorter ones are found in any random value.
LEAST_WORD = 4

#: A word costs at most so much a letter; of eight random letters one value in a hundred does.
LIKE_WORDS, LONGEST_WORD, LETTERS = 1.48, 24, 40

PUNCTUATION, JOINTS = ".,;:!?()[]{}…", re.compile("[-–'’/]")

#: Alphabets a guesser tries: small and capital letters, digits, symbols, and all else.
ALPHABETS = (26, 26, 10, 33, 100)


@lru_cache(maxsize=1)
def word_ranks() -> tuple[dict[str, int], int]:
    """Rank by word, WORDS first, and the length of the longest. At most as many as both vocabularies hold."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    found = [(i, w.removesuffix("</w>")) for w, i in vocab.items() if w.endswith("</w>")]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        pieces = [(int(i), base64.b64decode(w)) for w, i in map(bytes.split, f)]
    found += [(i, w[1:].decode(errors="replace").lower()) for i, w in pieces if w.startswith(b" ")]
    words = [*WORDS, *(w for _, w in sorted(found) if len(w) >= LEAST_WORD and w.isalpha())]
    ranks = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
    return ranks, max(map(len, ranks))


def _class(c: str) -> int:
    """The bit of the character's alphabet."""
    if not c.isascii():
        return 16
    return 1 if c.islower() else 2 if c.isupper() else 4 if c.isdigit() else 8


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest segmentation.

    A word costs its rank (twice that when in capitals or with swapped letters), a date the
    days of 150 years, a repeat or a keyboard walk its start and length, a run of other characters the size of
    the alphabets it is drawn from for each. Repeats
    and walks reach as far as they can from where they start; each part doubles the cost.
    """
    ranks, longest = word_ranks()
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, n = low.translate(LEET), len(value)
    part = math.log10(2)
    repeat, walk = [1] * (n + 1), [1] * (n + 1)
    for i in range(n - 2, -1, -1):
        if low[i] == low[i + 1]:
            repeat[i] = repeat[i + 1] + 1
        if (low[i], low[i + 1]) in STEPS:
            walk[i] = walk[i + 1] + 1
    classes = [_class(c) for c in value]
    sizes = {0: 0}
    for c in set(classes):
        sizes |= {m | c: s + ALPHABETS[c.bit_length() - 1] for m, s in sizes.items()}
    # The cost of a run that is open, by the alphabets it is drawn from.
    runs = [(m, math.log10(s)) for m, s in sizes.items() if m]
    opened = {m: math.inf for m, _ in runs}
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i] = min(best[i], *opened.values())
        for m, cost in runs:
            opened[m] = min(opened[m], here + part) + cost if m & classes[i] else math.inf
        moves = []
        for run in (repeat[i], walk[i]):
            if run > 2:
                moves.append((i + run, math.log10(50 * run) + part))
        if low[i].isdigit() and (m := DATE.match(low, i)):
            moves.append((m.end(), math.log10(365 * 150 if m.end() - i > 4 else 150) + part))
        for j in range(i + 2, min(n, i + longest) + 1):
            for form in (low[i:j], plain[i:j]):
                if form in ranks:
                    turns = 1 + (value[i:j] != form)
                    moves.append((j, math.log10(ranks[form] * turns) + part))
        for j, cost in moves:
            best[j] = min(best[j], here + cost)
    return min(best[n], *opened.values()) if n else 0.0


@lru_cache(maxsize=1)
def letter_model() -> tuple[Counter, Counter]:
    """How often three letters, and the first two of them, follow one another in the words."""
    three, two = Counter(), Counter()
    for word in word_ranks()[0]:
        edged = f"^^{word}$"
        for i in range(len(edged) - 2):
            three[edged[i : i + 3]] += 1
            two[edged[i : i + 2]] += 1
    return three, two


def letter_cost(word: str) -> float:
    """log10 of the guesses per letter of a word that is made up letter by letter as words are."""
    three, two = letter_model()
    edged = f"^^{word.lower()}$"
    odds = [(three[edged[i : i + 3]] + 0.05) / (two[edged[i : i + 2]] + 0.05 * LETTERS) for i in range(len(edged) - 2)]
    return -sum(map(math.log10, odds)) / len(odds)


def reads_like_words(value: str) -> bool:
    """A word, or words joined by hyphens and the like, punctuation around them aside."""
    parts = JOINTS.split(value.strip(PUNCTUATION))
    plain = lambda w: w.isalpha() and (w.islower() or w.isupper() or w.istitle()) and len(w) <= LONGEST_WORD
    return all(plain(w) and (len(w) <= 3 or letter_cost(w) <= LIKE_WORDS) for w in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guessed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of costly values after credential words."""
    found, at = [], 0
    while m := CONTEXT.search(text, at):
        secret = guess_cost(m[1]) >= LEAST_COST and not reads_like_words(m[1])
        if secret:
            found.append((m.start(), 3, m.end()))
        at = m.end() if secret else m.start(1)
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess of every document."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            base = [base_spans(t) for t in texts_of(chunk)]
            more = [guessed_spans(t) for t in texts_of(chunk)]
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(3)]
            digests = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
            spans = [written(sorted(b + g)) for b, g in zip(base, more, strict=True)]
            tail = [pa.array(digests), pa.array(spans), pa.array([len(g) for g in more], pa.int64())]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *counts, *tail], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    )


def masked(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span of their texts replaced; all columns stay."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            out = []
            for text in chunk.column("text").to_pylist():
                if text:
                    parts, at = [], 0
                    for a, _, b in sorted(base_spans(text) + guessed_spans(text)):
                        if b > at:
                            parts += [text[at : max(a, at)], mark if a >= at else ""]
                            at = b
                    text = "".join([*parts, text[at:]])
                out.append(text)
            columns = [pa.array(out, pa.string()) if c == "text" else chunk.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
