"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between stages rows
are written as Parquet to the shared folder. All but the last return the columns of documents, with
every column but ``text`` (and ``n_chars``, its length) as it came.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import bpe, decontaminate, neardup, rules, secrets
from spanlake.llm.rewrite import cut, merged, rewritten
from spanlake.llm.stage import stage, unstage

#: A document goes when this share of its words stands in benchmark windows; the words of a lesser overlap are cut out.
DROP_SHARE = 0.5
MASK = "[SECRET]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return rules.judge(docs).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of smallest id. A row goes only for its text: different texts under one id stay."""
    return neardup.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that benchmark passages dominate; the passages are cut from the others."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.scan(docs, benchmark).filter(F.col("n_hit") < DROP_SHARE * F.greatest(F.col("n_words"), F.lit(1)))
    text = F.col("row")["text"]
    return rewritten(found, F.when(F.size("spans") > 0, cut(text, F.col("spans"), "")).otherwise(text))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked; every document stays."""
    found = secrets.scan(docs).select("row", merged(F.col("secret_spans")).alias("spans"))
    text = F.col("row")["text"]
    return rewritten(found, F.when(F.size("spans") > 0, cut(text, F.col("spans"), MASK)).otherwise(text))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, checked by decoding."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("secret_scan", without_secrets), ("bpe", tokens)]

#: Determinants, regular-expression places and merges have no SQL form here; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        unstage(before)
    return docs
