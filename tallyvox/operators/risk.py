"""Risk snapshots, queue, report lists, case selection, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.functions.scores import POLICY_VERSION, claimed_count, risk_score, risk_weight
from tallyvox.session import materialize, small_side

HIGH_LEVELS = ["P0", "P1"]
SCOPE_DAYS = {"DAILY": 1, "WEEKLY": 7}


def risk_snapshot(alerts: DataFrame, existing: DataFrame) -> DataFrame:
    """A frozen row per alert that has none yet; hours count from zero."""
    fresh = alerts.join(existing.select("ws", "alert_id"), ["ws", "alert_id"], "left_anti")
    scored = fresh.withColumn(
        "_r",
        risk_score(
            F.col("z_score"), F.col("current_count"), risk_weight(F.col("canonical_key")), F.lit(0)
        ),
    )
    return scored.select(
        "ws",
        "alert_id",
        F.col("_r.score").alias("score"),
        F.col("_r.level").alias("level"),
        F.array_join("_r.reasons", "；").alias("reasons"),
        F.lit(POLICY_VERSION).alias("policy_version"),
    )


def _named(snapshots: DataFrame, alerts: DataFrame, catalog: DataFrame) -> DataFrame:
    names = catalog.select("ws", "canonical_key", "canonical_name")
    return (
        snapshots.select("ws", "alert_id", "score", "level", "reasons")
        .join(alerts, ["ws", "alert_id"])
        .join(names, ["ws", "canonical_key"])
    )


def risk_queue(snapshots: DataFrame, alerts: DataFrame, catalog: DataFrame) -> DataFrame:
    """What to handle first; snapshots without alert or topic drop out."""
    return (
        _named(snapshots, alerts, catalog)
        .select(
            "ws", "alert_id", "canonical_key", "canonical_name", "score", "level", "reasons",
            "current_count", "z_score", "created_at",
        )
        .orderBy(F.desc("score"), F.desc("created_at"), "ws", "alert_id")
    )


def report_risks(
    alerts: DataFrame, snapshots: DataFrame, catalog: DataFrame, start: Column, end: Column
) -> DataFrame:
    in_range = alerts.filter((F.col("created_at") >= start) & (F.col("created_at") < end))
    return (
        _named(snapshots, in_range, catalog)
        .select(
            "ws", "alert_id", "canonical_key", "canonical_name", "score", "level", "reasons", "created_at"
        )
        .orderBy(F.desc("created_at"), "ws", "alert_id")
    )


def report_evidence(
    cases: DataFrame,
    evidence: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    scope: str | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Evidence of confirmed cases, by evidence time range or by how recently the case changed."""
    confirmed = cases.filter(F.col("status") == "CONFIRMED")
    if scope in SCOPE_DAYS:
        since = as_of - F.make_dt_interval(days=F.lit(SCOPE_DAYS[scope]))
        confirmed = confirmed.filter(F.col("updated_at") >= since)
    rows = evidence
    if start is not None:
        rows = rows.filter((F.col("created_at") >= start) & (F.col("created_at") < end))
    return rows.join(confirmed.select("ws", "case_id", "alert_id"), ["ws", "case_id"])


def notification_outbox(snapshots: DataFrame, queued: DataFrame) -> DataFrame:
    return (
        snapshots.filter(F.col("level").isin(HIGH_LEVELS))
        .join(queued, ["ws", "alert_id"], "left_anti")
        .select("ws", "alert_id")
    )


def open_cases(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """A case for every alert without one; running it again adds nothing."""
    missing = alerts.join(cases.select("ws", "alert_id"), ["ws", "alert_id"], "left_anti")
    return missing.select(
        "ws",
        "alert_id",
        F.sha2(F.concat_ws("|", F.col("ws").cast("string"), F.col("alert_id").cast("string")), 256).alias(
            "case_id"
        ),
        F.lit("OPEN").alias("status"),
        F.col("created_at").alias("opened_at"),
    )


def follow_up_overdue(cases: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    limit = as_of - F.make_dt_interval(mins=F.lit(minutes))
    return cases.filter(
        (F.col("follow_up_status") == "AWAITING")
        & F.col("reminded_at").isNull()
        & (F.col("created_at") < limit)
    )


def report_facts(
    coverage: DataFrame, top_issues: DataFrame, expressions: DataFrame, risks: DataFrame
) -> DataFrame:
    """Total over the full coverage, mentions per topic and expression, number of risks."""

    def mentions(df: DataFrame, key: str, name: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct(key, "feedback_count")))
        return df.groupBy("ws").agg(F.map_from_entries(entries).alias(name))

    counted = risks.groupBy("ws").agg(F.count(F.lit(1)).alias("risk_count"))
    return (
        coverage.select("ws", F.col("total_events").alias("total"))
        .join(mentions(top_issues, "canonical_name", "issue_mentions"), "ws", "left")
        .join(mentions(expressions, "expression", "expression_mentions"), "ws", "left")
        .join(counted, "ws", "left")
        .fillna(0, ["risk_count"])
    )


def reconcile(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Check rows per report: the summary's ticket count, each mention's upper bound, overrides.

    `claims(report_id, ws, summary, mentions map<issue, n>)`, `facts(ws, total, issue_mentions)`. Counts are
    read out of the summaries before the join, and facts of few workspaces go to every task, so no text is
    shuffled and a workspace with most reports is not one task.
    """
    counted = claims.select("report_id", "ws", "mentions", claimed_count(F.col("summary")).alias("claimed"))
    joined = counted.join(small_side(materialize(facts.select("ws", "total", "issue_mentions"))), "ws")
    checks = F.concat(
        F.array(
            F.struct(
                F.lit("executiveSummary ticket count").alias("check"),
                (F.col("claimed") == F.col("total")).alias("passed"),
                F.format_string("claimed=%d, actual=%d", "claimed", "total").alias("detail"),
                F.lit(None).cast("string").alias("override"),
            )
        ),
        F.transform(
            F.map_entries("mentions"),
            lambda m: F.struct(
                F.concat(F.lit("alert "), m["key"], F.lit(" mentions upper bound")).alias("check"),
                (m["value"] <= F.col("total")).alias("passed"),
                F.concat(
                    F.lit("mentions="), m["value"].cast("string"), F.lit(", actual="),
                    F.col("total").cast("string"),
                ).alias("detail"),
                F.when(
                    F.col("issue_mentions")[m["key"]] != m["value"],
                    F.col("issue_mentions")[m["key"]].cast("string"),
                ).alias("override"),
            ),
        ),
    )
    sound = F.forall("checks", lambda c: c["passed"] & c["override"].isNull())
    return (
        joined.withColumn("checks", checks)
        .withColumn("ok", sound)
        .select("report_id", "ok", F.inline("checks"))
    )


def alert_history(alerts: DataFrame, n: int = 5) -> DataFrame:
    """Up to `n` earlier alerts of the same topic, newest first.

    Earlier alerts are the preceding rows in (created, id) order, so no pairs are formed.
    """
    order = Window.partitionBy("ws", "canonical_key").orderBy("created_at", "alert_id")
    previous = order.rowsBetween(-n, -1)
    row = F.struct("created_at", "alert_id", "bucket_start", "current_count", "z_score", "status")
    return alerts.select(
        "ws",
        "canonical_key",
        "alert_id",
        F.reverse(F.collect_list(row).over(previous)).alias("history"),
    )
