"""From raw documents to packed training sequences: quality, near duplicates, personal data, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.llm.minhash import near_duplicates
from tallyvox.llm.packing import pack
from tallyvox.llm.pii import personal_spans
from tallyvox.llm.quality import quality_scores
from tallyvox.session import checkpoint_dir, configure

CUTOFF = 0.3
SHARE = 80  # near duplicates share 80 % of their five-word shingles
CAPACITY = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier does not reject, as they are; every row is judged by its own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels, CUTOFF, keep=True).where("predicted = 1").select("row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id.

    Rows of one doc_id are one document: they stay or go together, and of those with the same text
    one stays. Rows without doc_id stay.
    """
    kept = near_duplicates(docs, SHARE).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind in brackets; n_chars follows a changed text."""
    found = personal_spans(docs, keep=True)
    changed = F.size("spans") > 0
    shown = {
        "text": F.col("redacted"),
        "n_chars": F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return found.select(*(shown.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("personal_data", personal_data),
    ("packing", packing),
]

ORACLE_SQL = None  # models and tokenizers are not expressible in SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each one's result is written as Parquet and read by the next."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
