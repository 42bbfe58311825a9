"""Topic catalog, completeness of projections, pending reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING_SAMPLE = "样本不可用"


def catalog_upsert(existing: DataFrame, links: DataFrame, names: DataFrame) -> DataFrame:
    """Catalog after seeing `links(ws, canonical_key, occurred_at)`: known names stay."""
    seen = links.groupBy("ws", "canonical_key").agg(
        F.min("occurred_at").alias("new_first"), F.max("occurred_at").alias("new_last")
    )
    named = seen.join(
        names.select("canonical_key", F.col("name").alias("new_name")), "canonical_key", "left"
    )
    return existing.join(named, ["ws", "canonical_key"], "full_outer").select(
        "ws",
        "canonical_key",
        F.coalesce("canonical_name", "new_name", "canonical_key").alias("canonical_name"),
        F.least("first_seen", "new_first").alias("first_seen"),
        F.greatest("last_seen", "new_last").alias("last_seen"),
    )


def alias_upsert(existing: DataFrame, catalog: DataFrame) -> DataFrame:
    """New aliases only: a name is recorded once per workspace, for the smallest key."""
    wanted = (
        catalog.withColumn("normalized_alias", F.col("canonical_name"))
        .groupBy("ws", "normalized_alias")
        .agg(F.min("canonical_key").alias("canonical_key"))
    )
    return wanted.join(existing, ["ws", "normalized_alias"], "left_anti")


def completeness_check(events: DataFrame, cells: DataFrame, annotations: DataFrame) -> DataFrame:
    """A workspace with events needs a rebuild unless it has both cells and annotations."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("ws").agg(F.count(F.lit(1)).alias(name))

    joined = (
        counted(events, "n_events")
        .join(counted(cells, "n_cells"), "ws", "full_outer")
        .join(counted(annotations, "n_annotations"), "ws", "full_outer")
        .fillna(0, ["n_events", "n_cells", "n_annotations"])
    )
    complete = (F.col("n_cells") > 0) & (F.col("n_annotations") > 0)
    return joined.withColumn("needs_rebuild", (F.col("n_events") > 0) & ~complete)


def pending_reviews(
    candidates: DataFrame, events: DataFrame, reason: str | Column | None = None
) -> DataFrame:
    """Pending candidates with the text they are about; order by created_at on reading."""
    pending = candidates.filter(F.col("status") == "pending")
    if reason is not None:
        pending = pending.filter(F.col("reason_code") == reason)
    sample = events.select("event_id", F.col("sanitized_text").alias("_text"))
    return pending.join(sample, "event_id", "left").withColumn(
        "sample_text", F.coalesce("_text", F.lit(MISSING_SAMPLE))
    ).drop("_text")
