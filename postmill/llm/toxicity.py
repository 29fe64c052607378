"""A toxicity classifier that identity terms alone do not move.

Texts become sets of words and word beginnings. A logistic regression over the features that tell
the labels apart is fitted to a bounded sample of labelled texts. For every sample text that names
a group the fit also sees the text with its identity terms swapped for others, and pays for
the squared change of the score, so the weights of such terms are drawn together and the mention of
a group, as such, neither adds nor takes.

Only the text enters a score. Scoring is one pass with the weights (as many as the sample has
telling features) shipped to the tasks.

Edge cases: a null or empty text has the score of the intercept; repeated labels of a document count
as the highest; null labels and labels without a document are left out; with no label, or only
one value of it, every score is the share of label 1 (0 without labels); an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import text_chunks, texts_of

#: Labelled texts used for the fit at most: those with the smallest hashes.
SAMPLE_ROWS = 12_000

#: Texts a feature must occur in, and its least z score, to enter the fit.
LEAST_TEXTS, LEAST_Z = 5, 3.0

# Group nouns and adjectives whose members are swapped for each other.
IDENTITY = (
    "women men woman man girls boys muslim muslims christian christians jewish jews jew hindu hindus buddhist "
    "buddhists atheist atheists catholic catholics gay lesbian straight bisexual transgender trans queer black "
    "white asian african american european mexican chinese indian arab arabs latino latina immigrant immigrants "
    "refugee refugees migrant migrants foreigner foreigners disabled deaf blind autistic elderly young old poor "
    "teacher teachers nurse nurses frauen männer juden muslime christen ausländer flüchtlinge femmes hommes "
    "musulmans juifs chrétiens immigrés mujeres hombres musulmanes judíos cristianos inmigrantes"
).split()

TOKEN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(TOKEN.findall(text.lower()))


def features_of(word: str) -> list[str]:
    """A word, and its beginnings of 4 and 5 letters."""
    return [word, *(f"{word[:n]}-" for n in (4, 5) if len(word) > n)]


@dataclass
class Model:
    """Intercept and weights by feature."""

    intercept: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text."""
        known: dict[str, tuple] = {}
        logits = np.full(len(texts), self.intercept)
        for i, text in enumerate(texts):
            seen = {}
            for w in words_of(text):
                own = known.get(w)
                if own is None:
                    own = known[w] = tuple((f, self.weights[f]) for f in features_of(w) if f in self.weights)
                if own:
                    seen.update(own)
            logits[i] += sum(seen.values())
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def swapped(words: set[str], turn: int) -> set[str]:
    """The words with each identity term replaced by another, which one depending on `turn`."""
    named = [w for w in IDENTITY if w in words]
    others = {IDENTITY[(IDENTITY.index(w) + 1 + turn * 7) % len(IDENTITY)] for w in named}
    return (words - set(named)) | others


def fit(texts: list[str], labels: list[int], penalty: float = 20.0, ridge: float = 0.3, rounds: int = 300) -> Model:
    """Ridge-regularised logistic regression with the counterfactual penalty, by accelerated gradient steps."""
    y = np.array(labels, float)
    share = float(y.mean()) if len(y) else 0.0
    if not len(y) or share in (0.0, 1.0):
        edge = min(max(share, 1e-9), 1 - 1e-9)
        return Model(float(np.log(edge / (1 - edge))))
    index: dict[str, int] = {}
    rows = []
    for text in texts:
        own = {index.setdefault(f, len(index)) for w in words_of(text) for f in features_of(w)}
        rows.append(np.fromiter(own, np.int32, len(own)))
    cells, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    there = np.bincount(cells, minlength=len(index))
    toxic = np.bincount(cells, np.repeat(y, sizes), minlength=len(index))
    clean = there - toxic
    gap = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / (len(y) - y.sum() + 1))
    telling = (there >= LEAST_TEXTS) & (np.abs(gap) / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)) >= LEAST_Z)
    new = np.cumsum(telling) - 1
    scale = np.abs(gap[telling])
    names = [f for f, i in index.items() if telling[i]]

    def matrix(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        picked = [new[p[telling[p]]] for p in parts]
        return np.concatenate([*picked, np.empty(0, int)]), np.repeat(np.arange(len(parts)), [len(p) for p in picked])

    x, of = matrix(rows)
    named, pairs = [], []
    for i, text in enumerate(texts):
        words = words_of(text)
        if not words.isdisjoint(IDENTITY):
            other = swapped(words, i)
            named.append(rows[i])
            pairs.append(np.array([index[f] for f in {f for w in other for f in features_of(w)} if f in index], int))
    (xa, a), (xb, b), n_pairs = *(matrix(p) for p in (named, pairs)), len(named)

    def gradient(w: np.ndarray, c: float) -> tuple[np.ndarray, float]:
        v = w * scale
        miss = 1 / (1 + np.exp(-np.clip(np.bincount(of, v[x], len(y)) + c, -30, 30))) - y
        g = np.bincount(x, miss[of], len(w)) / len(y)
        if n_pairs:
            change = (np.bincount(a, v[xa], n_pairs) - np.bincount(b, v[xb], n_pairs)) * penalty / len(y)
            g += np.bincount(xa, change[a], len(w)) - np.bincount(xb, change[b], len(w))
        return g * scale + ridge / len(y) * w, float(miss.mean())

    w, c = np.zeros(len(names)), float(np.log(share / (1 - share)))
    mean_w, square_w, mean_c, square_c = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        g, gc = gradient(w, c)
        mean_w, square_w = 0.9 * mean_w + 0.1 * g, 0.999 * square_w + 0.001 * g * g
        mean_c, square_c = 0.9 * mean_c + 0.1 * gc, 0.999 * square_c + 0.001 * gc * gc
        up, down = 1 - 0.9**t, 1 - 0.999**t
        rate = 0.05 * (1 - t / (rounds + 1))
        w = w - rate * (mean_w / up) / (np.sqrt(square_w / down) + 1e-8)
        c = c - rate * (mean_c / up) / (np.sqrt(square_c / down) + 1e-8)
    return Model(c, dict(zip(names, (w * scale).tolist(), strict=True)))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit to at most `sample_rows` labelled documents outside the held-out fifth."""
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    marks = usable.groupBy("doc_id").agg(F.max(label).alias("_y"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = docs.select("doc_id", "text").join(chosen, "doc_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            sets = [" ".join(sorted(words_of(t))) for t in texts_of(chunk)]
            columns = [chunk.column("doc_id").cast(pa.int64()), pa.array(sets, pa.string()), chunk.column("_y").cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "words", "y"])

    sets = picked.mapInArrow(words, "doc_id long, words string, y long")
    rows = sets.groupBy("doc_id").agg(F.min("words").alias("words"), F.max("y").alias("y")).orderBy("doc_id").toArrow()
    return fit(rows.column("words").to_pylist(), rows.column("y").to_pylist())


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the documents and `score`."""
    names = [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(model.score(texts_of(chunk)))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_toxicity(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
