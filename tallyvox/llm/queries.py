"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.llm import fingerprints as prints
from tallyvox.llm import warc
from tallyvox.llm.embeddings import embedding_groups
from tallyvox.llm.lm import lm_scores
from tallyvox.llm.merge_replay import encode_decode
from tallyvox.llm.minhash import near_duplicates
from tallyvox.llm.packing import pack
from tallyvox.llm.pii import span_digests
from tallyvox.llm.quality import quality_scores
from tallyvox.llm.repair import damage_and_repair
from tallyvox.llm.token_counts import token_counts
from tallyvox.llm.wavelet import write_and_read
from tallyvox.llm.whitening import whiten
from tallyvox.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[DataFrame, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark).read.parquet(f"{sf_dir}/{table}.parquet"), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_merkle_fingerprints", "documents", prints.SQL)
def op1(docs: DataFrame, sf_dir: str) -> DataFrame:
    return prints.fingerprints(docs)


@query("op2_int8_embedding_groups", "embeddings")
def op2(vectors: DataFrame, sf_dir: str) -> DataFrame:
    return embedding_groups(vectors, threshold=0.9)


@query("op3_quality", "documents")
def op3(docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_scores(docs, docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet"), cutoff=0.3)


@query("op4_cost_packing", "documents")
def op4(docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


@query("op5_personal_data", "documents")
def op5(docs: DataFrame, sf_dir: str) -> DataFrame:
    return span_digests(docs)


@query("op6_minhash_groups", "documents")
def op6(docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates(docs, share=85)


@query("op7_wavelet_shards", "documents")
def op7(docs: DataFrame, sf_dir: str) -> DataFrame:
    return write_and_read(docs, public_tokenizers.path("word_bpe_49k.json"), bits=16)


@query("op8_merge_replay", "documents")
def op8(docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op9_attention_scores", "documents")
def op9(docs: DataFrame, sf_dir: str) -> DataFrame:
    return lm_scores(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_token_counts", "documents")
def op10(docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query("op11_warc_capture_index", "pages", warc.SQL)
def op11(pages: DataFrame, sf_dir: str) -> DataFrame:
    return warc.write_and_read(pages)


@query("op12_whitening", "embeddings")
def op12(vectors: DataFrame, sf_dir: str) -> DataFrame:
    return whiten(vectors, components=4, weights="one").withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query("op13_conversation_repair", "conversations")
def op13(turns: DataFrame, sf_dir: str) -> DataFrame:
    return damage_and_repair(turns)
