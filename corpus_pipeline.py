"""From raw documents to token ids: toxicity, near duplicates, benchmark leaks, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet below
the shared checkpoint folder and read again as the next stage's docs.  The first three drop documents,
the fourth replaces secrets in their texts, the last returns token ids instead of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curata.llm import decontaminate, jaccard_join, secret_scan, toxicity
from curata.llm.common import read_table
from curata.llm.queries import bpe_digests
from curata.session import checkpointed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain judges toxic go."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents (five-word shingles, similarity 0.8) the smallest id stays."""
    return jaccard_join.keep_first(docs, words=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets inside the texts are replaced by a mark."""
    return secret_scan.without_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return bpe_digests(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", redact_secrets),
    ("byte_level_bpe", encode),
]

ORACLE_SQL = None       # classifier training and alignment are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
