"""Dashboard and report figures over cells, links, annotations, buckets and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.functions.text import cap_text
from tallyvox.session import small_side

DEFAULT_DAYS = 7
TOP = 5
SAMPLE_CAP = 200
UNKNOWN_ISSUE = "未知"


def coverage(cells: DataFrame) -> DataFrame:
    return cells.groupBy("ws").agg(
        F.min("window_start").alias("start"),
        F.max("window_end").alias("end"),
        F.sum("event_count").alias("total_events"),
    )


def analysis_window(
    covered: DataFrame,
    as_of: Column,
    start_day: Column | None = None,
    end_day: Column | None = None,
    days: int = DEFAULT_DAYS,
) -> DataFrame:
    """Requested days clamped to the coverage, else the last days of the coverage; both ends count."""
    week = F.make_dt_interval(days=F.lit(days))
    if start_day is not None and end_day is not None:
        first = start_day.cast("timestamp")
        last = (F.date_add(end_day, 1)).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
        start = F.greatest(first, F.col("start"))
        end = F.least(last, F.col("end"))
        start = F.least(start, end)
    else:
        end = F.coalesce("end", as_of)
        start = F.greatest(end - week, F.when(F.col("end").isNotNull(), F.col("start")))
    return covered.select("ws", start.alias("window_start"), end.alias("window_end"))


def in_window(df: DataFrame, window: DataFrame, at: str) -> DataFrame:
    """Rows inside their workspace's window. The window table has one row per workspace.

    Counts the windows when called: few enough of them go to every task, and the rows stay where
    they are; more of them meet the rows by workspace.
    """
    return (
        df.join(small_side(window), "ws")
        .filter((F.col(at) >= F.col("window_start")) & (F.col(at) <= F.col("window_end")))
        .drop("window_start", "window_end")
    )


def half_open_range(df: DataFrame, column: str, start: Column, end: Column) -> DataFrame:
    """[start, end); an empty or inverted range is an error when it is read."""
    valid = F.assert_true(start < end, "range start must lie before its end").isNull()
    return df.filter(valid & (F.col(column) >= start) & (F.col(column) < end))


def ranked(df: DataFrame, k: int, order: list, per: str | list[str] = "ws") -> DataFrame:
    """First `k` rows per key. Spark limits each key before the shuffle, so hot keys stay small."""
    by = Window.partitionBy(*([per] if isinstance(per, str) else per)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def expression_topics(
    annotations: DataFrame, links: DataFrame, window: DataFrame, expression: str | None = None
) -> DataFrame:
    """Topic counts of the events with an expression inside the window, largest first on reading."""
    rows = in_window(annotations, window, "occurred_at")
    if expression is not None:
        rows = rows.filter(F.col("expression") == expression)
    return (
        links.select("event_id", "canonical_key")
        .join(rows.select("ws", "event_id", "expression"), "event_id")
        .groupBy("ws", "expression", "canonical_key")
        .agg(F.count(F.lit(1)).alias("feedback_count"))
    )


def expression_topic_samples(
    annotations: DataFrame, links: DataFrame, window: DataFrame, k: int = TOP
) -> DataFrame:
    rows = in_window(annotations, window, "occurred_at").select("ws", "event_id", "expression")
    pairs = links.select("event_id", "canonical_key").distinct().join(rows, "event_id")
    return ranked(pairs, k, ["event_id"], ["ws", "expression", "canonical_key"])


def topic_catalog_fill(workspaces: DataFrame, topics: DataFrame, counts: DataFrame) -> DataFrame:
    """Every eligible topic of every workspace, zero where nothing was counted."""
    entry = F.struct("sort_order", "canonical_key", "name")
    packed = topics.filter("alert_eligible").groupBy(F.lit(1).alias("_one")).agg(F.array_sort(F.collect_list(entry)).alias("_topics"))
    places = workspaces.select("ws").distinct().withColumn("_one", F.lit(1))
    grid = places.join(packed, "_one").select("ws", F.inline("_topics"))
    return (
        grid.join(counts.select("ws", "canonical_key", "feedback_count"), ["ws", "canonical_key"], "left")
        .withColumn("feedback_count", F.coalesce("feedback_count", F.lit(0)))
    )


def window_sums(buckets: DataFrame, window: DataFrame) -> DataFrame:
    return (
        in_window(buckets, window, "bucket_start")
        .groupBy("ws", "canonical_key")
        .agg(F.sum("feedback_count").alias("feedback_count"))
    )


def top_issues(buckets: DataFrame, window: DataFrame, k: int = TOP) -> DataFrame:
    return ranked(window_sums(buckets, window), k, [F.desc("feedback_count"), "canonical_key"])


def issue_list(catalog: DataFrame, buckets: DataFrame, window: DataFrame) -> DataFrame:
    return (
        catalog.select("ws", "canonical_key", "canonical_name")
        .join(window_sums(buckets, window), ["ws", "canonical_key"], "left")
        .withColumn("feedback_count", F.coalesce("feedback_count", F.lit(0)))
    )


def expression_distribution(
    annotations: DataFrame, window: DataFrame, labels: list[str]
) -> DataFrame:
    """All labels in rule order, zero where absent; one pass with one counter per label."""
    counters = [F.count_if(F.col("expression") == x).alias(f"c{i}") for i, x in enumerate(labels)]
    counted = in_window(annotations, window, "occurred_at").groupBy("ws").agg(*counters)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("label_pos"),
                F.lit(x).alias("expression"),
                F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("feedback_count"),
            )
            for i, x in enumerate(labels)
        ]
    )
    return window.select("ws").join(counted, "ws", "left").select("ws", F.inline(rows))


def expression_trend(buckets: DataFrame, window: DataFrame) -> DataFrame:
    rows = in_window(buckets, window, "bucket_start")
    entries = F.array_sort(F.collect_list(F.struct("expression", "feedback_count")))
    return rows.groupBy("ws", "bucket_start").agg(F.map_from_entries(entries).alias("counts"))


def trend_direction(buckets: DataFrame) -> DataFrame:
    """Last day against the day before it in the data."""
    rows = buckets.groupBy("ws", "canonical_key").agg(
        F.sort_array(F.collect_list(F.struct("bucket_start", "feedback_count")), asc=False).alias("d")
    )
    last, before = F.get("d", F.lit(0))["feedback_count"], F.get("d", F.lit(1))["feedback_count"]
    return rows.select("ws", "canonical_key", direction(last, before).alias("direction"))


def direction(last: Column, before: Column) -> Column:
    return (
        F.when(last > before, F.lit("up")).when(last < before, F.lit("down")).otherwise(F.lit("flat"))
    )


def eligible_overview(
    topics: DataFrame,
    links: DataFrame,
    events: DataFrame,
    buckets: DataFrame,
    alerts: DataFrame,
    catalog: DataFrame,
    window: DataFrame,
) -> dict[str, DataFrame]:
    """Alert-eligible topics only: per topic with direction, per day, and recent alerts.

    Recent alerts are the newest of all topics and filtered afterwards.
    """
    keys = topics.filter("alert_eligible").select("canonical_key")
    keys = small_side(keys)
    known = catalog.join(keys, "canonical_key", "left_semi")
    counts = (
        in_window(events.select("ws", "event_id", "occurred_at"), window, "occurred_at")
        .join(links.select("event_id", "canonical_key"), "event_id")
        .join(keys, "canonical_key", "left_semi")
        .groupBy("ws", "canonical_key")
        .agg(F.count(F.lit(1)).alias("feedback_count"))
    )
    eligible = in_window(buckets, window, "bucket_start").join(
        keys, "canonical_key", "left_semi"
    )
    per_topic = (
        topic_catalog_fill(window, topics, counts)
        .join(trend_direction(eligible), ["ws", "canonical_key"], "left")
        .withColumn("direction", F.coalesce("direction", F.lit("flat")))
    )
    per_day = eligible.groupBy("ws", "bucket_start").agg(
        F.sum("feedback_count").alias("feedback_count")
    )
    recent = ranked(alerts, TOP, [F.desc("created_at"), F.desc("alert_id")]).join(
        known.select("ws", "canonical_key"), ["ws", "canonical_key"], "left_semi"
    )
    return {"topics": per_topic, "trend": per_day, "recent_alerts": recent}


def period_columns(current: Column, previous: Column) -> dict[str, Column]:
    return {
        "delta": current - previous,
        "pct": F.when(previous != 0, (current - previous) * F.lit(100.0) / previous),
        "new_activity": (previous == 0) & (current > 0),
        "sufficient": (current != 0) | (previous != 0),
    }


def period_comparison(buckets: DataFrame, windows: DataFrame) -> DataFrame:
    """Both sums in one pass. `windows(ws, current_start, current_end, previous_start, previous_end)`."""
    joined = buckets.join(windows, "ws")
    at, n = F.col("bucket_start"), F.col("feedback_count")

    def total(start: str, end: str) -> Column:
        inside = (at >= F.col(start)) & (at < F.col(end))
        return F.coalesce(F.sum(F.when(inside, n)), F.lit(0))

    sums = joined.groupBy("ws", "canonical_key").agg(
        total("current_start", "current_end").alias("current"),
        total("previous_start", "previous_end").alias("previous"),
    )
    extra = period_columns(F.col("current"), F.col("previous"))
    return sums.withColumns(extra)


def topic_distribution(buckets: DataFrame, as_of: Column, days: int = DEFAULT_DAYS, k: int = TOP) -> DataFrame:
    since = as_of - F.make_dt_interval(days=F.lit(days))
    sums = (
        buckets.filter((F.col("bucket_start") >= since) & (F.col("bucket_start") < as_of))
        .groupBy("ws", "canonical_key")
        .agg(F.sum("feedback_count").alias("feedback_count"))
        .filter(F.col("feedback_count") > 0)
    )
    return ranked(sums, k, [F.desc("feedback_count"), "canonical_key"])


def issue_trend_series(buckets: DataFrame, window: DataFrame) -> DataFrame:
    rows = in_window(buckets, window, "bucket_start")
    return rows.groupBy("ws", "canonical_key").agg(
        F.array_sort(F.collect_list(F.struct("bucket_start", "feedback_count"))).alias("series")
    )


def recent_alerts(alerts: DataFrame, catalog: DataFrame, k: int = TOP) -> DataFrame:
    names = catalog.select("ws", "canonical_key", "canonical_name")
    return (
        ranked(alerts, k, [F.desc("created_at"), F.desc("alert_id")])
        .join(names, ["ws", "canonical_key"], "left")
        .withColumn("canonical_name", F.coalesce("canonical_name", F.lit(UNKNOWN_ISSUE)))
    )


def issue_samples(links: DataFrame, events: DataFrame, window: DataFrame, k: int = TOP) -> DataFrame:
    rows = in_window(events, window, "occurred_at").select("ws", "event_id", "sanitized_text")
    pairs = links.select("event_id", "canonical_key").distinct()
    return ranked(rows.join(pairs, "event_id"), k, ["event_id"], ["ws", "canonical_key"])


def cell_samples(
    cell_issues: DataFrame, events: DataFrame, window: DataFrame, k: int = TOP, cap: int = SAMPLE_CAP
) -> DataFrame:
    ids = cell_issues.select(
        "ws", "canonical_key", F.explode("sample_event_ids").alias("event_id")
    ).distinct()
    texts = in_window(events, window, "occurred_at").filter(
        F.trim(F.coalesce("sanitized_text", F.lit(""))) != ""
    )
    rows = ids.join(texts.select("ws", "event_id", "sanitized_text"), ["ws", "event_id"])
    return ranked(rows, k, ["event_id"], ["ws", "canonical_key"]).withColumn(
        "sample_text", cap_text(F.col("sanitized_text"), cap)
    ).drop("sanitized_text")


def issue_detail(
    catalog: DataFrame,
    buckets: DataFrame,
    alerts: DataFrame,
    profiles: DataFrame,
    links: DataFrame,
    events: DataFrame,
    window: DataFrame,
    k: int = TOP,
) -> DataFrame:
    """One row per topic of the catalog: days inside the window, all alerts, baseline, samples.

    Alerts are newest first. A topic without days, alerts or samples has empty lists, one without a
    profile a null baseline. Lists are bounded by the calendar or by `k`; sample ids are chosen
    before any text is read.
    """
    key = ["ws", "canonical_key"]
    alert = F.struct("created_at", "alert_id", "bucket_start", "current_count", "z_score", "status")
    history = alerts.groupBy(*key).agg(F.sort_array(F.collect_list(alert), asc=False).alias("alerts"))
    profile = profiles.select(*key, F.struct("active_buckets", "ewma", "variance", "status", "last_bucket").alias("baseline"))
    seen = in_window(events.select("ws", "event_id", "occurred_at"), window, "occurred_at").drop("occurred_at")
    chosen = ranked(seen.join(links.select("event_id", "canonical_key").distinct(), "event_id"), k, ["event_id"], key)
    texts = chosen.join(events.select("ws", "event_id", "sanitized_text"), ["ws", "event_id"])
    samples = texts.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "event_id", "sanitized_text"))).alias("samples")
    )
    head = catalog.select(*key, "canonical_name").join(window.select("ws", "window_start", "window_end"), "ws", "left")
    rows = head.join(issue_trend_series(buckets, window).withColumnRenamed("series", "trend"), key, "left")
    for part in (history, profile, samples):
        rows = rows.join(part, key, "left")
    lists = ["trend", "alerts", "samples"]
    return rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in lists})


def latest_run(runs: DataFrame, at: str = "created_at", key: str = "run_id") -> DataFrame:
    """Newest run per workspace, picked by a maximum that is combined before the shuffle."""
    rest = [c for c in runs.columns if c != "ws"]
    newest = runs.groupBy("ws").agg(F.max_by(F.struct(*rest), F.struct(at, key)).alias("r"))
    return newest.select("ws", "r.*")


def dashboard_summary(
    covered: DataFrame,
    window: DataFrame,
    issues: DataFrame,
    alerts: DataFrame,
    status: DataFrame,
    projection: DataFrame,
    expressions: DataFrame,
    trend: DataFrame,
    pending: DataFrame,
) -> DataFrame:
    """One row per workspace; every list is already cut to its top rows or to the label list."""

    def gathered(df: DataFrame, columns: list[str], name: str) -> DataFrame:
        return df.groupBy("ws").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    waiting = pending.groupBy("ws").agg(F.count(F.lit(1)).alias("pending_count"))
    result = covered.join(window, "ws", "left")
    for part in (
        gathered(issues, ["rank", "canonical_key", "feedback_count"], "top_issues"),
        gathered(alerts, ["rank", "canonical_key", "alert_id"], "recent_alerts"),
        status,
        projection.select("ws", F.col("run_id").alias("latest_projection")),
        gathered(expressions, ["label_pos", "expression", "feedback_count"], "expressions"),
        gathered(trend, ["bucket_start", "expression", "feedback_count"], "expression_trend"),
        waiting,
    ):
        result = result.join(part, "ws", "left")
    return result.fillna(0, ["pending_count", "building", "active"])
