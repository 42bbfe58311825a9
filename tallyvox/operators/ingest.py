"""Cleaning, checking and de-duplicating feedback rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.functions.text import (
    PHONE_PATTERN_CN,
    import_normalize,
    is_blank,
    java_trim,
    parse_occurred_at,
    pii_mask,
    sha256_hex,
    source_kind,
)
from tallyvox.sources.feedback_csv import REQUIRED_FIELDS

EVENT_KEY = ["ws", "source_id", "external_ref_hash"]
BLANK_AFTER_MASK = "反馈文本脱敏后为空。"
BAD_TIME = "occurred_at 必须是 ISO 8601 或 yyyy-MM-dd HH:mm:ss 时间。"
ERROR_LIMIT = 10


def required(c: Column, field: str) -> Column:
    return F.when(is_blank(c), F.lit(f"{field} 不能为空。"))


def to_events(mapped: DataFrame, phone: str = PHONE_PATTERN_CN) -> DataFrame:
    """Event columns plus `error`: the first check that a row fails, null for good rows."""
    masked = java_trim(pii_mask(F.col("feedback_text"), phone))
    rows = mapped.withColumns(
        {"sanitized_text": masked, "event_time": parse_occurred_at(F.col("occurred_at"))}
    )
    error = F.coalesce(
        *[required(F.col(name), name) for name in REQUIRED_FIELDS],
        # Marks are never empty, so a text is blank after masking exactly when it is blank before.
        F.when(is_blank(F.col("feedback_text")), F.lit(BLANK_AFTER_MASK)),
        F.when(F.col("event_time").isNull(), F.lit(BAD_TIME)),
    )
    normalized = import_normalize(F.col("sanitized_text"))
    return rows.withColumns(
        {
            "error": error,
            "external_ref_hash": sha256_hex(java_trim(F.col("external_ref"))),
            "source_kind": source_kind(F.col("source")),
            "normalized_text": normalized,
            "content_hash": sha256_hex(normalized),
        }
    ).drop("feedback_text", "occurred_at", "source", "external_ref").withColumnRenamed(
        "event_time", "occurred_at"
    )


def drop_blank(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    blank = is_blank(F.col(column))
    return df.filter(~blank), df.filter(blank)


def dedupe_insert(
    new: DataFrame, existing: DataFrame, key: list[str] = EVENT_KEY, sequence: str = "_seq"
) -> DataFrame:
    """Marks every row imported, duplicate or failed; the first row of a key in file order wins.

    The winner per key is a minimum that is combined before the shuffle, so a key holding a large
    share of the rows costs one partial result per task.
    """
    good = new.filter(F.col("error").isNull())
    winners = good.groupBy(*key).agg(F.min(sequence).alias("_first"))
    fresh = winners.join(existing.select(*key).distinct(), key, "left_anti").select(
        F.col("_first"), F.lit(True).alias("_new")
    )
    marked = new.join(fresh, new[sequence] == fresh["_first"], "left")
    outcome = (
        F.when(F.col("error").isNotNull(), F.lit("failed"))
        .when(F.col("_new"), F.lit("imported"))
        .otherwise(F.lit("duplicate"))
    )
    return marked.withColumn("outcome", outcome).drop("_first", "_new")


def import_report(rows: DataFrame, limit: int = ERROR_LIMIT) -> DataFrame:
    """Per file: totals and the first rejected rows. `row_no` counts records from 1."""
    totals = rows.groupBy("_file").agg(
        F.count_if(F.col("outcome") == "imported").alias("imported"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
    order = Window.partitionBy("_file").orderBy("row_no")
    first = (
        rows.filter(F.col("outcome") == "failed")
        .select("_file", "row_no", "error")
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= limit)
        .groupBy("_file")
        .agg(F.array_sort(F.collect_list(F.struct("row_no", "error"))).alias("_errors"))
    )
    lines = F.transform(
        "_errors",
        lambda e: F.concat(
            F.lit("第 "), (e["row_no"] + 1).cast("string"), F.lit(" 行："), e["error"]
        ),
    )
    return totals.join(first, "_file", "left").select(
        F.col("_file").alias("file"),
        "imported",
        "duplicates",
        "failed",
        F.coalesce(lines, F.array().cast("array<string>")).alias("errors"),
    )


def load_events(files: DataFrame, tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Events ingested by the latest task of each linked file."""
    newest = tasks.groupBy("file_id").agg(
        F.max_by("task_id", F.struct("created_at", "task_id")).alias("task_id")
    )
    chosen = files.join(newest, "file_id").select("task_id").distinct()
    return events.join(chosen, events["ingested_task_id"] == chosen["task_id"], "left_semi")
