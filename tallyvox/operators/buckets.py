"""Daily counts per topic and per expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_of(c: Column) -> Column:
    return F.date_trunc("day", c)


def _count_map(name: str, value: str) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value))))


def issue_daily_buckets(events: DataFrame, links: DataFrame) -> DataFrame:
    """Counts per (workspace, topic, day) with a sorted source map.

    Counting by source first keeps the combine before the shuffle; the second step only sees one
    row per source.
    """
    rows = events.select("ws", "event_id", "occurred_at", "source_kind").join(
        links.select("event_id", "canonical_key"), "event_id"
    )
    return bucket_counts(rows)


def bucket_counts(rows: DataFrame) -> DataFrame:
    """`rows(ws, canonical_key, occurred_at, source_kind)`, one per link."""
    by_source = rows.groupBy(
        "ws", "canonical_key", day_of(F.col("occurred_at")).alias("bucket_start"), "source_kind"
    ).agg(F.count(F.lit(1)).alias("n"))
    return by_source.groupBy("ws", "canonical_key", "bucket_start").agg(
        F.sum("n").alias("feedback_count"), _count_map("source_kind", "n").alias("source_counts")
    )


def bucket_merge(existing: DataFrame, delta: DataFrame) -> DataFrame:
    """Additive merge; source maps are summed key by key."""
    key = ["ws", "canonical_key", "bucket_start"]
    both = existing.select(*key, "feedback_count", "source_counts").unionByName(
        delta.select(*key, "feedback_count", "source_counts")
    )
    counts = both.groupBy(*key).agg(F.sum("feedback_count").alias("feedback_count"))
    maps = (
        both.select(*key, F.explode("source_counts").alias("source_kind", "n"))
        .groupBy(*key, "source_kind")
        .agg(F.sum("n").alias("n"))
        .groupBy(*key)
        .agg(_count_map("source_kind", "n").alias("source_counts"))
    )
    empty = F.create_map().cast("map<string,bigint>")
    return counts.join(maps, key, "left").withColumn(
        "source_counts", F.coalesce("source_counts", empty)
    )


def expression_daily_buckets(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy(
        "ws", "expression", day_of(F.col("occurred_at")).alias("bucket_start")
    ).agg(F.count(F.lit(1)).alias("feedback_count"))
