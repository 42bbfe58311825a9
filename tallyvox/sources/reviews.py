"""Nested review records flattened to the feedback file contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.text import java_trim

RECORD = (
    "moment struct<id_str:string,created_time:bigint,review:struct<id:string,score:string,"
    "contents:struct<raw_text:string,text:string>>>, identification string"
)


def _non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def flatten_reviews(
    raw: DataFrame,
    start: Column,
    end: Column,
    column: str = "json",
    source: str = "review",
    platform: str = "review",
    base_url: str = "",
) -> DataFrame:
    """Rows without id, time or text, or outside [start, end], are dropped; profile fields too."""
    item = raw.select(F.from_json(column, RECORD).alias("r")).select(
        "r.identification",
        F.col("r.moment.id_str").alias("moment_id"),
        F.col("r.moment.created_time").alias("created"),
        F.col("r.moment.review").alias("review"),
    )
    reference = F.coalesce(
        _non_empty(F.col("identification")), _non_empty(F.col("moment_id")), F.col("review.id")
    )
    text = java_trim(
        F.coalesce(
            _non_empty(F.col("review.contents.raw_text")), F.col("review.contents.text"), F.lit("")
        )
    )
    review_id = F.coalesce(
        _non_empty(F.col("review.id")), F.element_at(F.split(reference, ":"), -1)
    )
    occurred = F.timestamp_seconds(F.when(F.col("created") != 0, F.col("created")))
    return (
        item.select(
            text.alias("feedback_text"),
            occurred.alias("occurred_at"),
            F.lit(source).alias("source"),
            reference.alias("external_ref"),
            F.coalesce(F.col("review.score"), F.lit("")).alias("rating"),
            F.lit(platform).alias("platform"),
            F.concat(F.lit(f"{base_url}/review/"), review_id).alias("source_url"),
        )
        .filter(F.col("external_ref").isNotNull() & F.col("occurred_at").between(start, end))
        .filter(F.col("feedback_text") != "")
    )
