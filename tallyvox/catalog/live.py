"""Streaming jobs driven to completion over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyvox.catalog import feedback as fb
from tallyvox.catalog import inputs as src
from tallyvox.catalog.base import query
from tallyvox.catalog.inputs import with_tables
from tallyvox.session import checkpoint_dir
from tallyvox.streaming import jobs


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/tallyvox_live/{name}-{uuid.uuid4().hex}"


def _drain(writer: DataStreamWriter, folder: str) -> None:
    running = (
        writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    running.awaitTermination()


def _arrivals(df: DataFrame, parts: int = 3) -> list[DataFrame]:
    """The month of events in successive thirds, as they would arrive."""
    third = F.least(F.floor((F.dayofmonth("occurred_at") - 1) / F.lit(10)), F.lit(parts - 1))
    return [df.filter(third == i) for i in range(parts)]


def _stream_of(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(path)


@query("stream_ingest", with_tables("""
SELECT DISTINCT ws, external_ref_hash FROM (SELECT 1::BIGINT AS ws, external_ref_hash FROM t_cleaned WHERE error IS NULL) q"""))
def _(spark, sf):
    folder = _folder(spark, "ingest")
    rows = fb.raw_feedback(spark, sf)
    columns = [c for c in rows.columns if not c.startswith("_")]
    for part in range(2):
        (
            rows.filter(F.col("_seq") % 2 == part).select(*columns)
            .write.mode("append").option("header", "true").option("escape", '"').csv(f"{folder}/in")
        )
        writer = jobs.stream_ingest(
            spark, f"{folder}/in", fb.MAPPING, columns, f"{folder}/events", F.lit(1).cast("bigint"), F.lit(1)
        )
        _drain(writer, folder)
    return spark.read.parquet(f"{folder}/events").select("ws", "external_ref_hash")


@query("stream_buckets", with_tables("SELECT ws, canonical_key, bucket_start, feedback_count FROM t_buckets"))
def _(spark, sf):
    folder = _folder(spark, "buckets")
    links = src.links(spark, sf).select("ws", "canonical_key", "occurred_at", "source_kind")
    # The newest part arrives first: late events still reach their day.
    for part in reversed(_arrivals(links)):
        part.write.mode("append").parquet(f"{folder}/in")
        _drain(jobs.stream_buckets(_stream_of(spark, f"{folder}/in", links), f"{folder}/out"), folder)
    return jobs.current_buckets(spark, f"{folder}/out").drop("source_counts")


@query("stream_cells", with_tables("""
SELECT ws::VARCHAR AS ws, cell_no, min(occurred_at) AS window_start, max(occurred_at) AS window_end, count(*) AS event_count, CAST(sum(tokens) AS BIGINT) AS estimated_tokens
FROM t_numbered n GROUP BY ws, cell_no
HAVING cell_no < (SELECT max(cell_no) FROM t_numbered m WHERE m.ws = n.ws AND m.occurred_at <= (SELECT max(occurred_at) FROM t_events) - INTERVAL 10 MINUTE)
    OR min(occurred_at) + INTERVAL 60 MINUTE < (SELECT max(occurred_at) FROM t_events) - INTERVAL 10 MINUTE""", recursive=True))
def _(spark, sf):
    folder = _folder(spark, "cells")
    events = src.feedback(spark, sf).select("ws", "event_id", "occurred_at", "normalized_text")
    for part in _arrivals(events):
        part.write.mode("append").parquet(f"{folder}/in")
        _drain(jobs.stream_cells(_stream_of(spark, f"{folder}/in", events), f"{folder}/out"), folder)
    return spark.read.parquet(f"{folder}/out/cells").drop("close_reason", "batch_id")


@query("stream_baseline_alerts", with_tables("""
SELECT ws, canonical_key, bucket_start, feedback_count, effective_threshold FROM t_prior
WHERE fires AND bucket_start + INTERVAL 1 DAY <= (SELECT max(occurred_at) FROM t_events) - INTERVAL 1 DAY""", recursive=True))
def _(spark, sf):
    folder = _folder(spark, "alerts")
    links = src.links(spark, sf).select("ws", "canonical_key", "occurred_at")
    for part in _arrivals(links):
        part.write.mode("append").parquet(f"{folder}/in")
        _drain(jobs.stream_baseline_alerts(_stream_of(spark, f"{folder}/in", links), f"{folder}/out"), folder)
    return spark.read.parquet(f"{folder}/out/alerts").select(
        "ws", "canonical_key", "bucket_start", "feedback_count", "effective_threshold"
    )
