"""Quality rules with host verdicts: a document falls by its own text or by its host's record.

Each text is measured and held against every rule. The failures of a host are counted rule by rule, and
each rule gets a beta prior of its own, fitted to the hosts' rates by the method of moments. A host fails as
a whole where, for some rule, its posterior lies clearly beyond the prior: its mean less two of its standard
deviations is above the prior's mean plus two of the prior's. So a small host or a common weakness condemns
nobody. Only numbers are staged and counted; partial counts are taken before the shuffle, so a host with a
third of all rows is one row a task.

Edge cases: a null or empty text has no words and fails; a null host is a host of its own; repeated
rows count each; with no spread between hosts the prior is as strong as all rows together, so each
host gets about the common rate; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import shared_folder, staged, text_chunks

#: Words of a window whose repetition counts.
WINDOW = 8

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"

#: What a text must not show, rule by rule: few words, repetition, symbols, repeated lines, odd word lengths.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "lengths": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}

#: The rules that a document falls by itself.
BASE_RULES = ("short", "repeats")

#: Standard deviations between a posterior and the prior.
APART = 2.0

SYMBOLS = b"#*$%&|<>"
BLANK_BYTES = b" \t\n\x0b\x0c\r"


def _lookup(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_SYMBOL, IS_BLANK = _lookup(SYMBOLS), _lookup(BLANK_BYTES)


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Per document the words inside windows that occur twice or more in it.

    `ids` numbers the words, `doc` says whose they are. Runs of 2, 4 and 8 words get exact
    numbers by ranking pairs of shorter runs, so equal numbers mean equal words.
    """
    n = len(ids) - window + 1
    if n < 1:
        return np.zeros(n_docs, np.int64)
    number, span = ids.astype(np.int64), 1
    while span < window:
        left, right = number[:-span], number[span:]
        number = np.unique(left * (number.max() + 1) + right, return_inverse=True)[1]
        span *= 2
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    _, at, counts = np.unique(doc[inside] * (number.max() + 1) + number[inside], return_inverse=True, return_counts=True)
    starts = inside[counts[at] > 1]
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n_docs)


def measure_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of UTF-8 texts."""
    n_docs, numbers = len(texts), {}
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), np.int64, int(counts.sum()))
    chars, symbols, dup_lines, n_lines = (np.zeros(n_docs, np.int64) for _ in range(4))
    for i, text in enumerate(texts):
        b = np.frombuffer(text, np.uint8)
        chars[i] = np.count_nonzero(((b & 0xC0) != 0x80) & ~IS_BLANK[b])
        symbols[i] = np.count_nonzero(IS_SYMBOL[b])
        lines = [line for line in text.split(b"\n") if line.strip(BLANK_BYTES)]
        n_lines[i], dup_lines[i] = len(lines), len(lines) - len(set(lines))
    return {
        "n_words": counts,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated_words(ids, np.repeat(np.arange(n_docs), counts), n_docs),
        "n_lines": n_lines,
    }


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns of `keep` and the measures of every whole text."""
    names = [*keep, *(c.split()[0] for c in MEASURES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "_text"):
            found = measure_texts([t or b"" for t in chunk.column("_text").to_pylist()])
            columns = [chunk.column(c) for c in keep] + [pa.array(v, pa.int64()) for v in found.values()]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, {MEASURES}")


def host_verdicts(judged: DataFrame, host: str, rules: Iterable[str]) -> DataFrame:
    """Per host: n, rates (the posterior mean of each rule's failure rate, in a struct) and host_failed.

    With m the mean and v the variance of the hosts' rates, a rule's prior has weight s = m(1-m)/v - 1, at least
    1 and at most the number of rows; a host's posterior has the mean (failures + m s) / (n + s).
    `judged` has a boolean column per rule.
    """
    rules = list(rules)
    failures = [F.count_if(F.col(r)).alias(r) for r in rules]
    hosts = judged.groupBy(host).agg(F.count("*").alias("n"), *failures)
    rate = lambda r: F.col(r) / F.col("n")
    fitted = hosts.agg(
        F.sum("n").alias("rows"), *[f(rate(r)).alias(f"{k}_{r}") for r in rules for k, f in (("m", F.avg), ("v", F.var_pop))]
    )
    m, v, rows = (lambda r: F.col(f"m_{r}")), (lambda r: F.col(f"v_{r}")), F.col("rows")
    weight = lambda r: F.when(v(r) > 0, m(r) * (1 - m(r)) / v(r) - 1).otherwise(rows)
    priors = [F.struct(m(r).alias("m"), F.greatest(F.lit(1.0), F.least(weight(r), rows)).alias("s")).alias(r) for r in rules]
    known = hosts.withColumn("_prior", fitted.select(F.struct(*priors)).scalar())
    m, s, n = (lambda r: F.col(f"_prior.{r}.m")), (lambda r: F.col(f"_prior.{r}.s")), F.col("n")
    means = {r: (F.col(r) + m(r) * s(r)) / (n + s(r)) for r in rules}
    spread = lambda p, k: F.sqrt(p * (1 - p) / (k + 1))
    failed = [means[r] - APART * spread(means[r], n + s(r)) > m(r) + APART * spread(m(r), s(r)) for r in rules]
    rates = F.struct(*[p.alias(r) for r, p in means.items()]).alias("rates")
    return known.select(host, "n", rates, reduce(or_, failed).alias("host_failed"))


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed, kept, whether the host failed and its shrunk rate by rule."""
    folder = shared_folder(docs.sparkSession)
    tests = {r: F.expr(test) for r, test in RULES.items()}
    judged = staged(measure(docs, keep=("doc_id", host)).withColumns(tests), folder, "judged")
    hosts = staged(host_verdicts(judged, host, RULES), folder, "hosts")
    verdict = hosts.select(F.col(host).alias("_host"), "rates", "host_failed")
    base = reduce(or_, [F.col(r) for r in BASE_RULES])
    return judged.join(verdict, F.col(host).eqNullSafe(F.col("_host")), "left").select(
        "doc_id",
        *(c.split()[0] for c in MEASURES.split(", ")[:5]),
        base.alias("base_failed"),
        (~base & ~F.col("host_failed")).alias("kept"),
        "host_failed",
        *[F.round(F.col(f"rates.{r}"), 9).alias(f"rate_{r}") for r in RULES],
    )
