"""The registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import byte_bpe, decontaminate, license_scan, near_duplicates, quality_rules, ranked_search
from postmill.llm import secret_scan, surrogates, token_output, token_rollup, toxicity, url_filter, whitening
from postmill.llm.common import shared_folder, table

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: A page whose markup holds as many runs of three symbols is listed as junk.
JUNK_RUN, JUNK_RUNS = r"[#*$%]{3}", 20

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
END_ID = 2


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    junk = F.regexp_count("html", F.lit(JUNK_RUN)) >= JUNK_RUNS
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, lambda pages: pages.filter(junk))


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter; a second tokenizer follows; short ones leave; symbols are washed out of the rest."""
    docs = table(spark, sf_dir, "documents")
    words = F.coalesce(F.regexp_count("text", F.lit(token_rollup.TOKENIZERS["words-1"])), F.lit(0))
    short, long = docs.filter(words < 20), docs.filter(words >= 20)
    washed = F.regexp_replace("text", r"[#*$%&|<>]+", " ")
    rollup = token_rollup.TokenRollup(spark, shared_folder(spark))
    rollup.commit("load", token_rollup.inserts(token_rollup.counted(docs, "words-1")))
    rollup.commit("second-tokenizer", token_rollup.inserts(token_rollup.counted(docs, "pieces-1")))
    dropped = token_rollup.deletes(token_rollup.counted(short, "words-1", "pieces-1"))
    rollup.commit("short", dropped)
    rollup.compact()
    rollup.commit("short", dropped)
    before = token_rollup.counted(long, "words-1", "pieces-1")
    after = token_rollup.counted(long, "words-1", "pieces-1", text=washed)
    rollup.commit("washed", token_rollup.revisions(before, after))
    return rollup.totals()


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, WORD_BPE, END_ID, fold_case=True)
    return token_output.read_tokens(spark, path).drop("ids")


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_personal_data(docs, "surrogates of the corpus")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digests(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans are written as label:start:end:edits, comma-joined."""
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["edits"]))
    return license_scan.license_scan(table(spark, sf_dir, "documents")).withColumn("spans", F.array_join(spans, ","))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_decontaminate,
        op2_url_filter,
        op3_token_rollup,
        op4_token_output,
        op5_surrogates,
        op6_byte_bpe,
        op7_toxicity,
        op8_quality_rules,
        op9_secret_scan,
        op10_near_duplicates,
        op11_license_scan,
        op12_whitening,
        op13_ranked_search,
    )
}
