"""A corpus pipeline: each stage reads what the one before kept and writes Parquet for the next.

Edge cases, in every stage: a null or empty text is clean, has no near duplicate, no passage and no secret, and
has no ids; texts of any length are taken whole; an empty table stays empty. Columns other than those of
documents are dropped, whatever their names. Rows are kept or dropped one by one, equal rows alike, but for near
duplicates, where ids decide: rows that repeat a doc_id share its fate, and rows without one stay.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import byte_bpe, decontaminate, near_duplicates, secret_scan, toxicity
from postmill.llm.common import limit_batches, shared_folder, table

#: Columns of documents; all but the last stage return them.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject. It learns from the labels of the corpus."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select(COLUMNS), model).filter("score < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group."""
    found = near_duplicates.near_duplicates(docs.select("doc_id", "text"), percent=80)
    gone = found.filter("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. A row goes by its id and text: ids may be null or repeated."""
    keyed = docs.withColumn("_key", F.concat_ws(" ", F.col("doc_id").cast("string"), F.sha2("text", 256)))
    probed = keyed.select(F.col("_key").alias("doc_id"), "text")
    hit = decontaminate.contaminated(probed, table(spark, sf_dir, "benchmark"), "string").select(F.col("doc_id").alias("_key"))
    return keyed.join(hit, "_key", "left_anti").select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark, and their new lengths."""
    clean = secret_scan.masked(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, proved by decoding them."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.bpe_digests(docs, path, public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage, with small batches on the way to its Python workers."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        limit_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", bounded(drop_toxic)),
    ("near_duplicates", bounded(drop_near_duplicates)),
    ("decontamination", bounded(drop_contaminated)),
    ("secret_scan", bounded(mask_secrets)),
    ("byte_bpe", bounded(encode)),
]

#: A trained classifier, hashed signatures and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last."""
    folder, docs = shared_folder(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
