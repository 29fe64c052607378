"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A change adds (+1) or takes back (-1) one document's count; a revision is both. Totals are additive, so
a batch is summed on its own and its few rows are written to a folder of its batch id; the file
that Spark writes last marks it whole. Committing the id again changes nothing, a batch that was
lost half way is unmarked, unread and overwritten by the retry. Reading sums the marked batches;
`compact` folds them into one base that remembers which ids it holds. Documents are never read again.

Edge cases: null sources, languages and texts are groups and counts of their own (a null text has no
tokens); repeated rows count each; an empty batch is committed and adds nothing; totals of zero documents
disappear; taking back what was never added leaves a negative total, not an error. Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

# Tokenizer versions and the pattern of their tokens.
TOKENIZERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]",
}


def counted(docs: DataFrame, *tokenizers: str, text: str | Column = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens), a row per document and tokenizer version."""
    body = F.col(text) if isinstance(text, str) else text
    each = [
        F.struct(F.lit(t).alias("tokenizer"), F.coalesce(F.regexp_count(body, F.lit(TOKENIZERS[t])), F.lit(0)).cast("long").alias("n_tokens"))
        for t in tokenizers
    ]
    return docs.select("doc_id", "source", "lang", F.explode(F.array(*each)).alias("_c")).select("doc_id", "source", "lang", "_c.*")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts taken back and given anew; a document may change its source or language on the way."""
    return deletes(before).unionByName(inserts(after))


def summed(changes: DataFrame) -> DataFrame:
    """Totals of signed changes; partial sums are taken before the shuffle."""
    sign = F.col("sign").cast("long")
    return changes.groupBy(*KEYS).agg(F.sum(sign).alias("n_docs"), F.sum(sign * F.col("n_tokens")).alias("n_tokens"))


class TokenRollup:
    """Totals under one folder of any Hadoop file system; one writer per batch id at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marked(self, kind: str) -> list[str]:
        found = self._fs.globStatus(self._path(f"{self.root}/{kind}=*/_SUCCESS")) or []
        return sorted(s.getPath().getParent().getName().partition("=")[2] for s in found)

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the batch ids it holds."""
        bases = self._marked("base")
        if not bases:
            return None, set()
        held = self.spark.read.parquet(f"{self.root}/held={bases[-1]}").collect()
        return bases[-1], {r["batch"] for r in held}

    def committed(self) -> set[str]:
        return self._base()[1] | set(self._marked("batch"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of (source, lang, tokenizer, n_tokens, sign); False if its id is there already."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("batch ids are letters, digits, dots, dashes and underscores")
        if batch in self.committed():
            return False
        summed(changes).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")
        return True

    def _open(self) -> tuple[list[str], list[str]]:
        base, held = self._base()
        new = sorted(set(self._marked("batch")) - held)
        return new, [*([f"{self.root}/base={base}"] if base else []), *(f"{self.root}/batch={b}" for b in new)]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all committed batches."""
        _, paths = self._open()
        parts = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        whole = parts.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return whole.filter("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold all batches into a new base; the list of its batches is written first, the base marks it."""
        new, paths = self._open()
        if not new:
            return
        old, held = self._base()
        name = f"{int(old.partition('-')[0]) + 1 if old else 0:08d}-{uuid.uuid4().hex[:8]}"
        ids = [(b,) for b in sorted(held | set(new))]
        self.spark.createDataFrame(ids, "batch string").coalesce(1).write.parquet(f"{self.root}/held={name}")
        self.totals().write.parquet(f"{self.root}/base={name}")
        for b in new:
            self._fs.delete(self._path(f"{self.root}/batch={b}"), True)
