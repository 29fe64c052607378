"""Plain loops that say what the operators must return."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts: dict[int, str | None], percent: int = 85) -> dict[int, int]:
    sets = {d: shingles(t) for d, t in texts.items()}
    holders: dict[tuple, list[int]] = {}
    label = {d: d for d in sets}

    def root(d: int) -> int:
        while label[d] != d:
            d = label[d]
        return d

    for d in sorted(sets):
        shared = Counter(e for s in sets[d] for e in holders.get(s, ()))
        for e, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                label[b] = a
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    return {d: root(d) for d in sets}


def quality(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ("assign", "access", "hex")
    spans.sort(key=lambda s: (s[1], order.index(s[0])))
    n = [sum(s[0] == k for s in spans) for k in order]
    return *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def u4(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def edits(probe: str, text: str) -> int:
    """Least edits of the probe against any place of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(probe, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)
