"""Dashboards, reports, risk and investigations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvox.catalog import inputs as src
from tallyvox.catalog.base import query
from tallyvox.catalog.inputs import AS_OF, CTES, LABELS, with_tables
from tallyvox.functions.scores import claimed_count, risk_score, risk_weight
from tallyvox.operators import baseline as bl
from tallyvox.operators import cells as ce
from tallyvox.operators import dashboard as db
from tallyvox.operators import investigation as iv
from tallyvox.operators import risk as rk
from tallyvox.sources import rule_tables as rt
from tallyvox.sources import sinks
from tallyvox.sources.rule_tables import Rule

TOPICS = [
    ("error", "Errors", True, 10), ("payment", "Payment", True, 20), ("click", "Clicks", False, 30),
    ("refund", "Refunds", True, 40), ("view", "Views", True, 50),
]
_TOPIC_VALUES = ", ".join(f"('{k}', '{n}', {str(e).lower()}, {o})" for k, n, e, o in TOPICS)
CTES["t_topics"] = f"SELECT * FROM (VALUES {_TOPIC_VALUES}) v(canonical_key, name, alert_eligible, sort_order)"
_LABEL_VALUES = ", ".join(f"({i}, '{x}')" for i, x in enumerate(LABELS))
CTES["t_label_list"] = f"SELECT * FROM (VALUES {_LABEL_VALUES}) v(label_pos, expression)"

CTES["t_in_window"] = "SELECT e.* FROM t_events e JOIN t_window w USING (ws) WHERE e.occurred_at BETWEEN w.w0 AND w.w1"
CTES["t_window_buckets"] = "SELECT b.* FROM t_buckets b JOIN t_window w USING (ws) WHERE b.bucket_start BETWEEN w.w0 AND w.w1"
CTES["t_window_annotations"] = "SELECT a.* FROM t_annotations a JOIN t_window w USING (ws) WHERE a.occurred_at BETWEEN w.w0 AND w.w1"


def topics(spark):
    return rt.topics_frame(spark, TOPICS)


def plain_links(spark, sf):
    return src.links(spark, sf).select("event_id", "canonical_key")


@query("expression_topics", with_tables("""
SELECT a.ws, a.expression, l.canonical_key, count(*) AS feedback_count
FROM t_window_annotations a JOIN t_links l USING (event_id) GROUP BY ALL"""))
def _(spark, sf):
    return db.expression_topics(src.annotations(spark, sf), plain_links(spark, sf), src.window(spark, sf))


@query("expression_topic_samples", with_tables("""
SELECT * FROM (SELECT a.ws, a.expression, l.canonical_key, event_id,
  row_number() OVER (PARTITION BY a.ws, a.expression, l.canonical_key ORDER BY event_id) AS rank
  FROM t_window_annotations a JOIN t_links l USING (event_id)) q WHERE rank <= 5"""))
def _(spark, sf):
    return db.expression_topic_samples(src.annotations(spark, sf), plain_links(spark, sf), src.window(spark, sf))


@query("topic_catalog_fill", with_tables("""
SELECT w.ws, t.canonical_key, t.name, t.sort_order::BIGINT AS sort_order, coalesce(c.n, 0) AS feedback_count
FROM (SELECT DISTINCT ws FROM t_events) w JOIN t_topics t ON t.alert_eligible
LEFT JOIN (SELECT ws, canonical_key, count(*) AS n FROM t_links GROUP BY ws, canonical_key) c
  ON c.ws = w.ws AND c.canonical_key = t.canonical_key"""))
def _(spark, sf):
    counts = src.links(spark, sf).groupBy("ws", "canonical_key").agg(F.count(F.lit(1)).alias("feedback_count"))
    return db.topic_catalog_fill(src.feedback(spark, sf), topics(spark), counts)


@query("coverage", with_tables("""
SELECT ws, min(window_start) AS "start", max(window_end) AS "end", CAST(sum(event_count) AS BIGINT) AS total_events FROM t_cells GROUP BY ws"""))
def _(spark, sf):
    return db.coverage(src.cells(spark, sf))


CTES["t_window_sums"] = "SELECT ws, canonical_key, CAST(sum(feedback_count) AS BIGINT) AS feedback_count FROM t_window_buckets GROUP BY ws, canonical_key"
CTES["t_top_issues"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY feedback_count DESC, canonical_key) AS rank FROM t_window_sums) q WHERE rank <= 5"""


@query("top_issues", with_tables("SELECT ws, canonical_key, feedback_count, rank FROM t_top_issues"))
def _(spark, sf):
    return db.top_issues(src.buckets(spark, sf), src.window(spark, sf))


@query("expression_distribution", with_tables("""
SELECT w.ws, l.label_pos::BIGINT AS label_pos, l.expression, (SELECT count(*) FROM t_window_annotations a WHERE a.ws = w.ws AND a.expression = l.expression) AS feedback_count
FROM t_window w JOIN t_label_list l ON true"""))
def _(spark, sf):
    return db.expression_distribution(src.annotations(spark, sf), src.window(spark, sf), LABELS)


CTES["t_expression_days"] = """
SELECT ws, expression, date_trunc('day', occurred_at)::TIMESTAMP AS bucket_start, count(*) AS feedback_count FROM t_annotations GROUP BY ALL"""


@query("expression_trend", with_tables("""
SELECT ws, bucket_start, string_agg(expression || '=' || feedback_count, '|' ORDER BY expression) AS counts
FROM t_expression_days JOIN t_window USING (ws) WHERE bucket_start BETWEEN w0 AND w1 GROUP BY ws, bucket_start"""))
def _(spark, sf):
    from tallyvox.operators.buckets import expression_daily_buckets

    return db.expression_trend(expression_daily_buckets(src.annotations(spark, sf)), src.window(spark, sf))


CTES["t_directions"] = """
SELECT ws, canonical_key, CASE WHEN max(n) < 2 THEN 'flat' WHEN max(CASE WHEN r = 1 THEN f END) > max(CASE WHEN r = 2 THEN f END) THEN 'up'
       WHEN max(CASE WHEN r = 1 THEN f END) < max(CASE WHEN r = 2 THEN f END) THEN 'down' ELSE 'flat' END AS direction
FROM (SELECT ws, canonical_key, feedback_count AS f, row_number() OVER (PARTITION BY ws, canonical_key ORDER BY bucket_start DESC) AS r,
             count(*) OVER (PARTITION BY ws, canonical_key) AS n FROM t_window_buckets) q GROUP BY ws, canonical_key"""


@query("eligible_overview", with_tables("""
SELECT w.ws, t.canonical_key, t.name, t.sort_order::BIGINT AS sort_order,
       (SELECT count(*) FROM t_in_window e JOIN t_links l USING (event_id) WHERE e.ws = w.ws AND l.canonical_key = t.canonical_key) AS feedback_count,
       coalesce(d.direction, 'flat') AS direction
FROM t_window w JOIN t_topics t ON t.alert_eligible
LEFT JOIN t_directions d ON d.ws = w.ws AND d.canonical_key = t.canonical_key"""))
def _(spark, sf):
    return overview(spark, sf)["topics"]


def overview(spark, sf):
    return db.eligible_overview(
        topics(spark), plain_links(spark, sf), src.feedback(spark, sf), src.buckets(spark, sf),
        src.alerts(spark, sf), src.topic_catalog(spark, sf), src.window(spark, sf),
    )


@query("eligible_trend", with_tables("""
SELECT ws, bucket_start, CAST(sum(feedback_count) AS BIGINT) AS feedback_count FROM t_window_buckets
WHERE canonical_key IN (SELECT canonical_key FROM t_topics WHERE alert_eligible) GROUP BY ws, bucket_start"""))
def _(spark, sf):
    return overview(spark, sf)["trend"]


CTES["t_recent_alerts"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY created_at DESC, alert_id DESC) AS rank FROM t_alerts) q WHERE rank <= 5"""


@query("eligible_recent_alerts", with_tables("""
SELECT ws, canonical_key, alert_id, rank FROM t_recent_alerts WHERE canonical_key IN (SELECT canonical_key FROM t_topics WHERE alert_eligible)"""))
def _(spark, sf):
    return overview(spark, sf)["recent_alerts"].select("ws", "canonical_key", "alert_id", "rank")


@query("issue_list", with_tables("""
SELECT c.ws, c.canonical_key, c.canonical_name, coalesce(s.feedback_count, 0) AS feedback_count
FROM t_catalog c LEFT JOIN t_window_sums s USING (ws, canonical_key)"""))
def _(spark, sf):
    return db.issue_list(src.topic_catalog(spark, sf), src.buckets(spark, sf), src.window(spark, sf))


@query("baseline_status", with_tables("""
WITH n AS (SELECT ws, canonical_key, count(*) AS d FROM t_buckets WHERE bucket_start < TIMESTAMP '2024-01-03' OR canonical_key IN ('view', 'click') GROUP BY ws, canonical_key)
SELECT ws, count(*) FILTER (d < 3) AS building, count(*) FILTER (d >= 3) AS active FROM n GROUP BY ws"""))
def _(spark, sf):
    some = src.buckets(spark, sf).filter("bucket_start < '2024-01-03' OR canonical_key IN ('view', 'click')")
    return bl.baseline_status(bl.ewma_baseline(some))


@query("period_comparison", with_tables("""
SELECT *, round((current - previous) * 100.0 / nullif(previous, 0), 6)::DOUBLE AS pct, previous = 0 AND current > 0 AS new_activity,
       current <> 0 OR previous <> 0 AS sufficient
FROM (SELECT ws, canonical_key, current, previous, current - previous AS delta FROM (
  SELECT ws, canonical_key,
         CAST(coalesce(sum(feedback_count) FILTER (bucket_start >= TIMESTAMP '2024-01-15' AND bucket_start < TIMESTAMP '2024-01-22'), 0) AS BIGINT) AS current,
         CAST(coalesce(sum(feedback_count) FILTER (bucket_start >= TIMESTAMP '2024-01-08' AND bucket_start < TIMESTAMP '2024-01-15'), 0) AS BIGINT) AS previous
  FROM t_buckets GROUP BY ws, canonical_key) a) b"""))
def _(spark, sf):
    stamp = lambda s, n: F.lit(s).cast("timestamp").alias(n)
    windows = src.feedback(spark, sf).select("ws").distinct().select(
        "ws", stamp("2024-01-15", "current_start"), stamp("2024-01-22", "current_end"),
        stamp("2024-01-08", "previous_start"), stamp("2024-01-15", "previous_end"),
    )
    return db.period_comparison(src.buckets(spark, sf), windows)


@query("topic_distribution", with_tables(f"""
SELECT * FROM (SELECT ws, canonical_key, CAST(sum(feedback_count) AS BIGINT) AS feedback_count,
  row_number() OVER (PARTITION BY ws ORDER BY sum(feedback_count) DESC, canonical_key) AS rank
  FROM t_buckets WHERE bucket_start >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND bucket_start < TIMESTAMP '{AS_OF}' GROUP BY ws, canonical_key) q WHERE rank <= 5"""))
def _(spark, sf):
    return db.topic_distribution(src.buckets(spark, sf), src.as_of())


@query("trend_direction", with_tables(CTES["t_directions"].replace("t_window_buckets", "t_buckets")))
def _(spark, sf):
    return db.trend_direction(src.buckets(spark, sf))


@query("issue_trend_series", with_tables("""
SELECT ws, canonical_key, string_agg(strftime(bucket_start, '%Y-%m-%d') || '=' || feedback_count, '|' ORDER BY bucket_start) AS series
FROM t_window_buckets GROUP BY ws, canonical_key"""))
def _(spark, sf):
    rows = db.issue_trend_series(src.buckets(spark, sf), src.window(spark, sf))
    day = lambda d: F.concat(F.date_format(d["bucket_start"], "yyyy-MM-dd"), F.lit("="), d["feedback_count"].cast("string"))
    return rows.withColumn("series", F.transform("series", day))


@query("recent_alerts", with_tables("""
SELECT a.ws, a.canonical_key, a.alert_id, a.rank, coalesce(c.canonical_name, '未知') AS canonical_name
FROM t_recent_alerts a LEFT JOIN (SELECT * FROM t_catalog WHERE canonical_key <> 'view') c USING (ws, canonical_key)"""))
def _(spark, sf):
    known = src.topic_catalog(spark, sf).filter("canonical_key <> 'view'")
    return db.recent_alerts(src.alerts(spark, sf), known).select("ws", "canonical_key", "alert_id", "rank", "canonical_name")


@query("issue_samples", with_tables("""
SELECT * FROM (SELECT e.ws, l.canonical_key, e.event_id, e.sanitized_text,
  row_number() OVER (PARTITION BY e.ws, l.canonical_key ORDER BY e.event_id) AS rank
  FROM t_in_window e JOIN t_links l USING (event_id)) q WHERE rank <= 5"""))
def _(spark, sf):
    return db.issue_samples(plain_links(spark, sf), src.feedback(spark, sf), src.window(spark, sf))


@query("issue_detail", with_tables("""
WITH b AS (SELECT ws, canonical_key, count(*) AS active FROM t_buckets GROUP BY ws, canonical_key),
s AS (SELECT e.ws, l.canonical_key, e.event_id, e.sanitized_text, row_number() OVER (PARTITION BY e.ws, l.canonical_key ORDER BY e.event_id) AS n
      FROM t_in_window e JOIN t_links l USING (event_id))
SELECT c.ws, c.canonical_key, c.canonical_name, w.w0 AS window_start, w.w1 AS window_end,
  coalesce((SELECT string_agg(strftime(x.bucket_start, '%Y-%m-%d') || '=' || x.feedback_count, '|' ORDER BY x.bucket_start) FROM t_window_buckets x WHERE x.ws = c.ws AND x.canonical_key = c.canonical_key), '') AS trend,
  coalesce((SELECT string_agg(a.alert_id || '=' || a.current_count || '=' || a.status, '|' ORDER BY a.created_at DESC, a.alert_id DESC) FROM t_alerts a WHERE a.ws = c.ws AND a.canonical_key = c.canonical_key), '') AS alerts,
  b.active AS active_buckets, CASE WHEN b.active >= 3 THEN 'active' ELSE 'baseline_building' END AS baseline_status,
  coalesce((SELECT string_agg(s.event_id || '=' || s.sanitized_text, '|' ORDER BY s.event_id) FROM s WHERE s.n <= 5 AND s.ws = c.ws AND s.canonical_key = c.canonical_key), '') AS samples
FROM t_catalog c JOIN t_window w USING (ws) JOIN b USING (ws, canonical_key)"""))
def _(spark, sf):
    buckets, catalog = src.buckets(spark, sf), src.topic_catalog(spark, sf)
    rows = db.issue_detail(
        catalog, buckets, src.alerts(spark, sf), bl.latest_profile(bl.ewma_baseline(buckets)),
        plain_links(spark, sf), src.feedback(spark, sf), src.window(spark, sf),
    )
    text = lambda *parts: F.concat_ws("=", *[p.cast("string") for p in parts])
    return rows.select(
        "ws", "canonical_key", "canonical_name", "window_start", "window_end",
        F.transform("trend", lambda d: text(F.date_format(d["bucket_start"], "yyyy-MM-dd"), d["feedback_count"])).alias("trend"),
        F.transform("alerts", lambda a: text(a["alert_id"], a["current_count"], a["status"])).alias("alerts"),
        "baseline.active_buckets", F.col("baseline.status").alias("baseline_status"),
        F.transform("samples", lambda x: text(x["event_id"], x["sanitized_text"])).alias("samples"),
    )


@query("cell_samples", with_tables("""
SELECT ws, canonical_key, event_id, rank, sample_text FROM (SELECT i.ws, i.canonical_key, i.event_id,
  CASE WHEN length(e.sanitized_text) <= 8 THEN e.sanitized_text ELSE substring(e.sanitized_text, 1, 8) || '…' END AS sample_text,
  row_number() OVER (PARTITION BY i.ws, i.canonical_key ORDER BY i.event_id) AS rank
  FROM (SELECT DISTINCT ws, canonical_key, unnest(sample_event_ids) AS event_id FROM t_cell_issues) i
  JOIN t_in_window e ON e.event_id = i.event_id AND e.ws = i.ws) q WHERE rank <= 5"""))
def _(spark, sf):
    return db.cell_samples(src.issues_of_cells(spark, sf), src.feedback(spark, sf), src.window(spark, sf), cap=8).select(
        "ws", "canonical_key", "event_id", "rank", "sample_text"
    )


@query("analysis_window", with_tables("""
SELECT ws, 'default' AS kind, w0 AS window_start, w1 AS window_end FROM t_window
UNION ALL SELECT ws, 'days', least(greatest(TIMESTAMP '2024-01-05', s), least(TIMESTAMP '2024-01-10 23:59:59.999999', e)), least(TIMESTAMP '2024-01-10 23:59:59.999999', e)
FROM (SELECT ws, min(window_start) AS s, max(window_end) AS e FROM t_cells GROUP BY ws) q"""))
def _(spark, sf):
    covered = db.coverage(src.cells(spark, sf))
    day = lambda s: F.lit(s).cast("date")
    chosen = db.analysis_window(covered, src.as_of(), day("2024-01-05"), day("2024-01-10"))
    return db.analysis_window(covered, src.as_of()).withColumn("kind", F.lit("default")).unionByName(
        chosen.withColumn("kind", F.lit("days"))
    )


@query("half_open_range", with_tables("""
SELECT ws, event_id, occurred_at FROM t_events WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-12'"""))
def _(spark, sf):
    stamp = lambda s: F.lit(s).cast("timestamp")
    rows = db.half_open_range(src.feedback(spark, sf), "occurred_at", stamp("2024-01-05"), stamp("2024-01-12"))
    return rows.select("ws", "event_id", "occurred_at")


@query("latest_run", with_tables("""
SELECT ws, run_id, agent_type, created_at FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY created_at DESC, run_id DESC) AS n FROM t_runs) q WHERE n = 1"""))
def _(spark, sf):
    return db.latest_run(src.runs(spark, sf).select("ws", "run_id", "agent_type", "created_at"))


@query("dashboard_summary", with_tables("""
SELECT c.ws, c.total_events, w.w0 AS window_start, w.w1 AS window_end, t.top_issues, a.recent_alerts, s.building, s.active, x.expressions,
       r.latest_projection, coalesce(p.pending_count, 0) AS pending_count
FROM (SELECT ws, CAST(sum(event_count) AS BIGINT) AS total_events FROM t_cells GROUP BY ws) c
JOIN t_window w USING (ws)
LEFT JOIN (SELECT ws, string_agg(canonical_key || '=' || feedback_count, '|' ORDER BY rank) AS top_issues FROM t_top_issues GROUP BY ws) t USING (ws)
LEFT JOIN (SELECT ws, string_agg(alert_id, '|' ORDER BY rank) AS recent_alerts FROM t_recent_alerts GROUP BY ws) a USING (ws)
LEFT JOIN (SELECT ws, count(*) FILTER (d < 3) AS building, count(*) FILTER (d >= 3) AS active
           FROM (SELECT ws, canonical_key, count(*) AS d FROM t_buckets GROUP BY ws, canonical_key) q GROUP BY ws) s USING (ws)
LEFT JOIN (SELECT ws, string_agg(expression || '=' || n, '|' ORDER BY label_pos) AS expressions FROM (
  SELECT w.ws, l.label_pos, l.expression, (SELECT count(*) FROM t_window_annotations a WHERE a.ws = w.ws AND a.expression = l.expression) AS n
  FROM t_window w JOIN t_label_list l ON true) q GROUP BY ws) x USING (ws)
LEFT JOIN (SELECT ws, run_id AS latest_projection FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY created_at DESC, run_id DESC) AS n FROM t_runs) q WHERE n = 1) r USING (ws)
LEFT JOIN (SELECT ws, count(*) AS pending_count FROM t_links WHERE sentiment = 'mixed' GROUP BY ws) p USING (ws)"""))
def _(spark, sf):
    from tallyvox.operators.buckets import expression_daily_buckets

    buckets, window = src.buckets(spark, sf), src.window(spark, sf)
    marks = src.annotations(spark, sf)
    days = db.in_window(expression_daily_buckets(marks), window, "bucket_start")
    summary = db.dashboard_summary(
        db.coverage(src.cells(spark, sf)), window, db.top_issues(buckets, window),
        db.recent_alerts(src.alerts(spark, sf), src.topic_catalog(spark, sf)),
        bl.baseline_status(bl.ewma_baseline(buckets)), db.latest_run(src.runs(spark, sf)),
        db.expression_distribution(marks, window, LABELS), days,
        src.links(spark, sf).filter("sentiment = 'mixed'"),
    )
    pair = lambda key: lambda x: F.concat(x[key], F.lit("="), x["feedback_count"].cast("string"))
    return summary.select(
        "ws", "total_events", "window_start", "window_end",
        F.transform("top_issues", pair("canonical_key")).alias("top_issues"),
        F.transform("recent_alerts", lambda x: x["alert_id"]).alias("recent_alerts"),
        "building", "active", F.transform("expressions", pair("expression")).alias("expressions"),
        "latest_projection", "pending_count",
    )


# --- risk ----------------------------------------------------------------------------------


@query("risk_score", """
SELECT o_orderkey, s AS score, CASE WHEN s >= 80 THEN 'P0' WHEN s >= 60 THEN 'P1' WHEN s >= 40 THEN 'P2' ELSE 'P3' END AS level,
       CASE WHEN surge >= 25 THEN '异常强度高' ELSE '异常强度有限' END || '|' || CASE WHEN volume >= 20 THEN '影响规模大' ELSE '影响规模小' END || '|' ||
       CASE WHEN issue >= 15 THEN '高风险主题' ELSE '一般风险主题' END || CASE WHEN age > 0 THEN '|尚未开始跟进 ' || age || ' 小时' ELSE '' END AS reasons
FROM (SELECT *, surge + volume + issue + age AS s FROM (
  SELECT o_orderkey, least(40, greatest(0, CAST(floor((o_totalprice / 50000.0 - 1) * 5 + 0.5) AS BIGINT))) AS surge,
         least(25, greatest(0, o_custkey % 40)) AS volume, least(20, greatest(0, o_orderkey % 25)) AS issue, least(15, greatest(0, o_orderkey % 18 - 2)) AS age
  FROM orders) q) r""")
def _(spark, sf):
    r = risk_score(
        F.col("o_totalprice") / F.lit(50000.0) - 1, F.col("o_custkey") % 40, F.col("o_orderkey") % 25, F.col("o_orderkey") % 18 - 2
    )
    return src.table(spark, sf, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", "r.score", "r.level", "r.reasons")


@query("risk_weight", with_tables("""
SELECT DISTINCT canonical_key, CASE WHEN canonical_key LIKE '%payment%' OR canonical_key LIKE '%login%' OR canonical_key LIKE '%charge%' OR canonical_key LIKE '%refund%' THEN 20
  WHEN canonical_key LIKE '%crash%' OR canonical_key LIKE '%stability%' THEN 15 ELSE 5 END::BIGINT AS weight FROM t_links"""))
def _(spark, sf):
    return plain_links(spark, sf).select("canonical_key").distinct().withColumn("weight", risk_weight(F.col("canonical_key")))


@query("risk_snapshot", with_tables("SELECT ws, alert_id, score, level, reasons, policy_version FROM t_snapshots WHERE ws <> 3"))
def _(spark, sf):
    rows = src.alerts(spark, sf)
    return rk.risk_snapshot(rows, rows.filter("ws = 3"))


@query("risk_queue", with_tables("""
SELECT s.ws, s.alert_id, a.canonical_key, c.canonical_name, s.score, s.level, s.reasons, a.current_count, round(a.z_score, 6) AS z_score, a.created_at
FROM t_snapshots s JOIN t_alerts a USING (ws, alert_id) JOIN (SELECT * FROM t_catalog WHERE canonical_key <> 'view') c ON c.ws = a.ws AND c.canonical_key = a.canonical_key"""))
def _(spark, sf):
    known = src.topic_catalog(spark, sf).filter("canonical_key <> 'view'")
    return rk.risk_queue(src.snapshots(spark, sf), src.alerts(spark, sf), known)


_T0, _T1 = "2024-01-10", "2024-01-20"


@query("report_risks", with_tables(f"""
SELECT s.ws, s.alert_id, a.canonical_key, c.canonical_name, s.score, s.level, s.reasons, a.created_at
FROM t_snapshots s JOIN t_alerts a USING (ws, alert_id) JOIN t_catalog c ON c.ws = a.ws AND c.canonical_key = a.canonical_key
WHERE a.created_at >= TIMESTAMP '{_T0}' AND a.created_at < TIMESTAMP '{_T1}'"""))
def _(spark, sf):
    stamp = lambda s: F.lit(s).cast("timestamp")
    return rk.report_risks(src.alerts(spark, sf), src.snapshots(spark, sf), src.topic_catalog(spark, sf), stamp(_T0), stamp(_T1))


CTES["t_case_evidence"] = """
SELECT ws, case_id, n AS evidence_no, created_at + to_hours(CAST(12 * n AS INTEGER)) AS created_at, 'ref-' || alert_id || '-' || n AS reference
FROM t_cases, (VALUES (0), (1), (2)) v(n)"""


def case_evidence(spark, sf):
    numbers = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    return src.cases_of_alerts(spark, sf).withColumn("evidence_no", numbers).select(
        "ws", "case_id", "evidence_no",
        (F.col("created_at") + F.make_dt_interval(hours=12 * F.col("evidence_no"))).alias("created_at"),
        F.concat_ws("-", F.lit("ref"), "alert_id", F.col("evidence_no").cast("string")).alias("reference"),
    )


@query("report_evidence", with_tables(f"""
SELECT 'range' AS kind, e.ws, e.case_id, e.evidence_no::BIGINT AS evidence_no, e.reference FROM t_case_evidence e JOIN t_cases c USING (ws, case_id)
WHERE c.status = 'CONFIRMED' AND e.created_at >= TIMESTAMP '{_T0}' AND e.created_at < TIMESTAMP '{_T1}'
UNION ALL
SELECT 'weekly', e.ws, e.case_id, e.evidence_no, e.reference FROM t_case_evidence e JOIN t_cases c USING (ws, case_id)
WHERE c.status = 'CONFIRMED' AND c.updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"""))
def _(spark, sf):
    stamp = lambda s: F.lit(s).cast("timestamp")
    known, rows = src.cases_of_alerts(spark, sf), case_evidence(spark, sf)
    parts = {
        "range": rk.report_evidence(known, rows, stamp(_T0), stamp(_T1)),
        "weekly": rk.report_evidence(known, rows, scope="WEEKLY", as_of=src.as_of()),
    }
    shown = [df.select(F.lit(k).alias("kind"), "ws", "case_id", "evidence_no", "reference") for k, df in parts.items()]
    return shown[0].unionByName(shown[1])


@query("notification_outbox", with_tables("""
SELECT ws, alert_id FROM t_snapshots WHERE level IN ('P0', 'P1') AND alert_id NOT IN (SELECT alert_id FROM t_alerts WHERE current_count % 2 = 0)"""))
def _(spark, sf):
    queued = src.alerts(spark, sf).filter("current_count % 2 = 0").select("ws", "alert_id")
    return rk.notification_outbox(src.snapshots(spark, sf), queued)


@query("case_open", with_tables("""
SELECT ws, alert_id, sha256(ws || '|' || alert_id) AS case_id, 'OPEN' AS status, created_at AS opened_at
FROM t_alerts WHERE alert_id NOT IN (SELECT alert_id FROM t_cases)"""))
def _(spark, sf):
    return rk.open_cases(src.alerts(spark, sf), src.cases_of_alerts(spark, sf))


@query("follow_up_overdue", with_tables("""
SELECT ws, case_id, created_at FROM t_cases WHERE follow_up_status = 'AWAITING' AND reminded_at IS NULL AND created_at < TIMESTAMP '2024-01-21 00:10:00' - INTERVAL 30 MINUTE"""))
def _(spark, sf):
    now = F.lit("2024-01-21 00:10:00").cast("timestamp")
    return rk.follow_up_overdue(src.cases_of_alerts(spark, sf), now).select("ws", "case_id", "created_at")


@query("report_merge", with_tables("""
SELECT c.ws, c.total, i.issue_mentions, x.expression_mentions, coalesce(r.risk_count, 0) AS risk_count
FROM (SELECT ws, CAST(sum(event_count) AS BIGINT) AS total FROM t_cells GROUP BY ws) c
LEFT JOIN (SELECT ws, string_agg(canonical_key || '=' || feedback_count, '|' ORDER BY canonical_key) AS issue_mentions FROM t_top_issues GROUP BY ws) i USING (ws)
LEFT JOIN (SELECT ws, string_agg(expression || '=' || n, '|' ORDER BY expression) AS expression_mentions FROM
  (SELECT ws, expression, count(*) AS n FROM t_window_annotations GROUP BY ws, expression) q GROUP BY ws) x USING (ws)
LEFT JOIN (SELECT ws, count(*) AS risk_count FROM t_snapshots GROUP BY ws) r USING (ws)"""))
def _(spark, sf):
    return facts(spark, sf)


def facts(spark, sf):
    window = src.window(spark, sf)
    top = db.top_issues(src.buckets(spark, sf), window).withColumn("canonical_name", F.col("canonical_key"))
    marks = db.in_window(src.annotations(spark, sf), window, "occurred_at").groupBy("ws", "expression").agg(
        F.count(F.lit(1)).alias("feedback_count")
    )
    return rk.report_facts(db.coverage(src.cells(spark, sf)), top, marks, src.snapshots(spark, sf))


@query("alert_history", with_tables("""
SELECT a.ws, a.canonical_key, a.alert_id,
       coalesce((SELECT string_agg(alert_id, '|' ORDER BY created_at DESC, alert_id DESC) FROM (
         SELECT b.alert_id, b.created_at FROM t_alerts b WHERE b.ws = a.ws AND b.canonical_key = a.canonical_key
           AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.alert_id < a.alert_id))
         ORDER BY created_at DESC, alert_id DESC LIMIT 5) q), '') AS history FROM t_alerts a"""))
def _(spark, sf):
    return rk.alert_history(src.alerts(spark, sf)).withColumn("history", F.transform("history", lambda h: h["alert_id"]))


@query("investigation_windows", with_tables("""
SELECT ws, canonical_key, alert_id, 'SHORT_TERM' AS window_type, bucket_start AS current_start, bucket_start + INTERVAL 1 DAY AS current_end,
       bucket_start - INTERVAL 1 DAY AS previous_start, bucket_start AS previous_end FROM t_alerts
UNION ALL SELECT ws, canonical_key, alert_id, 'WEEKLY', bucket_start - INTERVAL 6 DAY, bucket_start + INTERVAL 1 DAY,
       bucket_start - INTERVAL 13 DAY, bucket_start - INTERVAL 6 DAY FROM t_alerts"""))
def _(spark, sf):
    return iv.investigation_windows(src.alerts(spark, sf), "BOTH")


CTES["t_counted"] = """
SELECT a.ws, a.canonical_key, a.alert_id, a.bucket_start AS b0,
       CAST(coalesce(sum(b.feedback_count) FILTER (b.bucket_start >= a.bucket_start - INTERVAL 6 DAY AND b.bucket_start < a.bucket_start + INTERVAL 1 DAY), 0) AS BIGINT) AS cur,
       CAST(coalesce(sum(b.feedback_count) FILTER (b.bucket_start >= a.bucket_start - INTERVAL 13 DAY AND b.bucket_start < a.bucket_start - INTERVAL 6 DAY), 0) AS BIGINT) AS prev,
       string_agg(CASE WHEN b.bucket_start >= a.bucket_start - INTERVAL 6 DAY AND b.bucket_start < a.bucket_start + INTERVAL 1 DAY
         THEN 'bucketStart=' || strftime(b.bucket_start, '%Y-%m-%dT%H:%MZ') || '，feedbackCount=' || b.feedback_count END, '；' ORDER BY b.bucket_start) AS series
FROM t_alerts a JOIN t_buckets b ON b.ws = a.ws AND b.canonical_key = a.canonical_key GROUP BY a.ws, a.canonical_key, a.alert_id, a.bucket_start"""
_STAMP = "strftime({}, '%Y-%m-%dT%H:%MZ')"
_DESCRIBE = ("'windowType=WEEKLY，currentStart=' || " + _STAMP.format("b0 - INTERVAL 6 DAY") + " || '，currentEnd=' || " + _STAMP.format("b0 + INTERVAL 1 DAY")
             + " || '，previousStart=' || " + _STAMP.format("b0 - INTERVAL 13 DAY") + " || '，previousEnd=' || " + _STAMP.format("b0 - INTERVAL 6 DAY"))


def evidence_inputs(spark, sf):
    alerts = src.alerts(spark, sf)
    windows = iv.investigation_windows(alerts)
    known = ["ws", "canonical_key", "alert_id", "window_type"]
    samples = windows.select(*known, F.array(F.col("canonical_key")).alias("texts")).filter("ws <> 2")
    return alerts, windows, samples


@query("evidence_rows", with_tables(f"""
SELECT ws, alert_id, 'ISSUE_TREND' AS source_type, 'trend:' || canonical_key || ':WEEKLY' AS reference, '主题趋势（WEEKLY）' AS title,
       {_DESCRIBE} || '；来源 issue_metric_bucket（日粒度）；' || series || '。' AS content, true AS sufficient FROM t_counted
UNION ALL
SELECT ws, alert_id, 'PERIOD_COMPARISON', 'comparison:' || canonical_key || ':WEEKLY', '时间范围比较（WEEKLY）',
       {_DESCRIBE} || '；来源 issue_metric_bucket；currentCount=' || cur || '，previousCount=' || prev || '，absoluteDelta=' || printf('%+d', cur - prev) ||
       CASE WHEN prev = 0 THEN '，percentageChange=unavailable，newActivity=true。' ELSE '，percentageChange=' || printf('%+.1f', round((cur - prev) * 100.0 / prev, 1)) || '%，newActivity=false。' END, true FROM t_counted
UNION ALL
SELECT ws, alert_id, 'SAMPLE_FEEDBACK', 'samples:' || canonical_key || ':WEEKLY', '脱敏样本（WEEKLY）',
       {_DESCRIBE} || '；' || CASE WHEN ws <> 2 THEN '来源 feedback_event；样本：' || canonical_key ELSE '冻结窗口内没有可用的脱敏反馈样本；不使用窗口外样本补足。' END, ws <> 2 FROM t_counted
UNION ALL
SELECT ws, alert_id, 'ALERT', alert_id, '告警触发快照', '触发时间=' || {_STAMP.format('bucket_start')} || '；当前值=' || current_count || '；EWMA=' || printf('%.2f', round(ewma, 2)) ||
       '；标准差=' || printf('%.2f', round(std, 2)) || '；z-score=' || printf('%.2f', round(z_score, 2)) || '；生效阈值=' || effective_threshold || '；状态=ACTIVE', true FROM t_alerts"""))
def _(spark, sf):
    alerts, windows, samples = evidence_inputs(spark, sf)
    rows = iv.evidence_rows(alerts, rk.alert_history(alerts), windows, src.buckets(spark, sf), samples)
    return rows.filter("source_type <> 'ALERT_HISTORY'")


@query("investigation_summary", with_tables("""
SELECT ws, alert_id, canonical_key AS topics, 'WEEKLY' AS time_window,
       canonical_key || CASE WHEN cur > prev THEN ' 上升+' || (cur - prev) || '条' WHEN cur < prev THEN ' 下降' || (cur - prev) || '条' ELSE ' 持平0条' END || '（[WEEKLY]）' AS key_changes,
       CASE WHEN first_alert AND ws = 2 THEN '历史告警与基线、脱敏样本（WEEKLY）' WHEN first_alert THEN '历史告警与基线' WHEN ws = 2 THEN '脱敏样本（WEEKLY）' ELSE '无' END AS insufficient,
       5::BIGINT AS evidence_count
FROM (SELECT *, row_number() OVER (PARTITION BY ws, canonical_key ORDER BY b0, alert_id) = 1 AS first_alert FROM t_counted) q"""))
def _(spark, sf):
    alerts, windows, samples = evidence_inputs(spark, sf)
    days = src.buckets(spark, sf)
    rows = iv.evidence_rows(alerts, rk.alert_history(alerts), windows, days, samples)
    return iv.investigation_summary(iv.window_counts(windows, days), rows)


_SUMMARY_SQL = """
CASE doc_id % 4 WHEN 0 THEN '共 ' || doc_id || ' 条' WHEN 1 THEN '本周 ' || doc_id || ' 条工单 ' ELSE '工单 ' END || text"""
CTES["t_claims"] = f"SELECT doc_id, doc_id % 4 AS ws, {_SUMMARY_SQL} AS summary FROM documents"


def claims(spark, sf):
    i = F.col("doc_id")
    lead = (
        F.when(i % 4 == 0, F.concat(F.lit("共 "), i.cast("string"), F.lit(" 条")))
        .when(i % 4 == 1, F.concat(F.lit("本周 "), i.cast("string"), F.lit(" 条工单 ")))
        .otherwise(F.lit("工单 "))
    )
    return src.table(spark, sf, "documents").select(
        "doc_id", (i % 4).alias("ws"), F.concat(lead, "text").alias("summary")
    )


@query("claimed_count", with_tables("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN doc_id ELSE 0 END AS claimed FROM t_claims"))
def _(spark, sf):
    return claims(spark, sf).select("doc_id", claimed_count(F.col("summary")).alias("claimed"))


@query("reconcile", with_tables("""
WITH f AS (SELECT ws, CAST(sum(event_count) AS BIGINT) AS total FROM t_cells GROUP BY ws),
m AS (SELECT ws, feedback_count FROM t_top_issues WHERE canonical_key = 'payment'),
c AS (SELECT q.doc_id, q.ws, CASE WHEN q.doc_id % 4 = 1 THEN q.doc_id ELSE 0 END AS claimed, 100 + q.doc_id AS mention, f.total, m.feedback_count AS actual
      FROM t_claims q JOIN f USING (ws) LEFT JOIN m USING (ws)),
checks AS (SELECT doc_id AS report_id, 'executiveSummary ticket count' AS "check", claimed = total AS passed, 'claimed=' || claimed || ', actual=' || total AS detail, NULL AS override FROM c
  UNION ALL SELECT doc_id, 'alert payment mentions upper bound', mention <= total, 'mentions=' || mention || ', actual=' || total, CASE WHEN actual <> mention THEN actual::VARCHAR END FROM c)
SELECT report_id, bool_and(passed AND override IS NULL) OVER (PARTITION BY report_id) AS ok, "check", passed, detail, override FROM checks"""))
def _(spark, sf):
    rows = claims(spark, sf).select(
        F.col("doc_id").alias("report_id"), "ws", "summary",
        F.create_map(F.lit("payment"), 100 + F.col("doc_id")).alias("mentions"),
    )
    return rk.reconcile(rows, facts(spark, sf))


_MATCH_TOPICS = [("topic_a", "heit"), ("topic_b", "tion"), ("topic_c", "eron the"), ("topic_d", "建议")]
_MATCH_EXPRESSIONS = [
    Rule("expr_suggestion", "Sugg/建议", 40, ["趋势"]), Rule("expr_complaint", "Bad/ung", 30, ["que"]), Rule("expr_praise", "Good", 20, ["est"]),
]


@query("question_topic_match", with_tables("""
SELECT question_id, CASE WHEN contains(t, 'eron the') OR contains(t, 'topic_c') THEN 'topic_c' WHEN contains(t, 'tion') OR contains(t, 'topic_b') THEN 'topic_b'
         WHEN contains(t, 'heit') OR contains(t, 'topic_a') THEN 'topic_a' WHEN contains(t, '建议') OR contains(t, 'topic_d') THEN 'topic_d' END AS canonical_key,
       CASE WHEN contains(t, 'sugg') OR contains(t, '建议') THEN 'expr_suggestion' WHEN contains(t, 'bad') OR contains(t, 'ung') THEN 'expr_complaint'
         WHEN contains(t, 'good') THEN 'expr_praise' WHEN contains(t, '其他') THEN 'expr_other' WHEN contains(t, '趋势') THEN 'expr_suggestion' WHEN contains(t, 'que') THEN 'expr_complaint'
         WHEN contains(t, 'est') THEN 'expr_praise' END AS expression
FROM (SELECT question_id, lower(text) AS t FROM t_questions) q"""))
def _(spark, sf):
    return iv.question_topic_match(src.questions(spark, sf), _MATCH_TOPICS, _MATCH_EXPRESSIONS)


@query("report_json", with_tables(f"""
SELECT ws, 'total ' || total AS report, '2024-02-01T00:00:00Z' AS generated, n AS risks, first_issue, e AS evidence
FROM (SELECT ws, CAST(sum(event_count) AS BIGINT) AS total FROM t_cells GROUP BY ws) c
LEFT JOIN (SELECT ws, count(*) AS n, max(CASE WHEN rank = 1 THEN canonical_key END) AS first_issue FROM t_recent_alerts GROUP BY ws) r USING (ws)
LEFT JOIN (SELECT ws, count(*) AS e FROM t_top_issues GROUP BY ws) x USING (ws)"""))
def _(spark, sf):
    summary = db.coverage(src.cells(spark, sf)).select(
        "ws", F.concat(F.lit("total "), F.col("total_events").cast("string")).alias("report"),
        src.as_of().alias("generated_at"), F.col("start").alias("range_start"), F.col("end").alias("range_end"),
    )
    recent = db.recent_alerts(src.alerts(spark, sf), src.topic_catalog(spark, sf)).select(
        "ws", F.col("rank").alias("risk_pos"), F.col("canonical_key").alias("issue"), F.lit("P2").alias("level"), F.col("current_count").alias("score")
    )
    listed = db.top_issues(src.buckets(spark, sf), src.window(spark, sf)).select(
        "ws", F.col("rank").alias("evidence_pos"), F.col("canonical_key").alias("reference"), F.col("canonical_key").alias("title")
    )
    doc = lambda path: F.get_json_object("report_json", path)
    return sinks.report_json(summary, recent, listed).select(
        "ws", doc("$.report").alias("report"), doc("$.generatedAt").alias("generated"),
        F.json_array_length(doc("$.risks")).alias("risks"), doc("$.risks[0].issue").alias("first_issue"),
        F.json_array_length(doc("$.evidence")).alias("evidence"),
    )


@query("cell_text", with_tables("""
WITH s AS (SELECT DISTINCT i.ws, i.cell_no, e.event_id, e.sanitized_text FROM (SELECT ws, cell_no, unnest(sample_event_ids) AS event_id FROM t_cell_issues) i JOIN t_events e USING (event_id)),
o AS (SELECT *, sum(length(sanitized_text) + 1) OVER (PARTITION BY ws, cell_no ORDER BY event_id) - 1 AS upto FROM s),
k AS (SELECT *, max((upto > 30)::INT) OVER (PARTITION BY ws, cell_no ORDER BY event_id) AS stopped FROM o),
t AS (SELECT ws, cell_no, string_agg(sanitized_text || chr(10), '' ORDER BY event_id) AS cell_text FROM k WHERE stopped = 0 GROUP BY ws, cell_no)
SELECT ws, cell_no, cell_text FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY cell_no) AS n FROM t) q WHERE n <= 5"""))
def _(spark, sf):
    return ce.cell_text(src.issues_of_cells(spark, sf), src.feedback(spark, sf), cap=30)
