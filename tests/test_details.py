"""Details of topics, diagnostics of cases, evidence of questions."""

import datetime as dt

from pyspark.sql import functions as F

from tallyvox.operators import dashboard as db
from tallyvox.operators import evaluation as ev
from tallyvox.operators import investigation as iv
from tallyvox.sources.rule_tables import Rule

DAY = dt.datetime(2024, 1, 30)
EVIDENCE = "case_key string, sort_order int, granularity string, document_id long, version_no long, chunk_id long, requirement_key string"
RANKED = "case_key string, rank int, document_id long, version_no long, chunk_id long"


def at(days, **more):
    return DAY + dt.timedelta(days=days, **more)


def tables(spark):
    catalog = spark.createDataFrame([(1, "login", "Login"), (1, "idle", "Idle"), (2, "login", "Login")], "ws long, canonical_key string, canonical_name string")
    buckets = spark.createDataFrame([(1, "login", at(0), 4), (1, "login", at(-8), 6), (1, "login", at(-40), 9)], "ws long, canonical_key string, bucket_start timestamp, feedback_count long")
    alerts = spark.createDataFrame(
        [(1, "login", f"a{i}", at(i), 4 + i, 1.25, 2.0, "ACTIVE", at(i)) for i in range(7)],
        "ws long, canonical_key string, alert_id string, bucket_start timestamp, current_count long, ewma double, z_score double, status string, created_at timestamp",
    )
    events = spark.createDataFrame(
        [(1, i, at(0, hours=i), None if i == 2 else " " if i == 3 else "x" * 300 if i == 4 else f"t{i}") for i in range(1, 9)],
        "ws long, event_id long, occurred_at timestamp, sanitized_text string",
    )
    links = events.select("event_id", F.lit("login").alias("canonical_key"))
    window = spark.createDataFrame([(1, at(-1), at(1, milliseconds=5)), (2, at(-1), at(1))], "ws long, window_start timestamp, window_end timestamp")
    return catalog, buckets, alerts, events, links.unionAll(links), window


def test_issue_detail(spark):
    catalog, buckets, alerts, events, links, window = tables(spark)
    profiles = spark.createDataFrame([(1, "login", 3, 2.0, 1.0, "active", at(0))], "ws long, canonical_key string, active_buckets int, ewma double, variance double, status string, last_bucket timestamp")
    rows = {(r.ws, r.canonical_key): r for r in db.issue_detail(catalog, buckets, alerts, profiles, links, events, window).collect()}
    login, idle = rows[1, "login"], rows[1, "idle"]
    assert len(rows) == 3 and [d.feedback_count for d in login.trend] == [4]
    assert [a.alert_id for a in login.alerts] == [f"a{i}" for i in (6, 5, 4, 3, 2, 1, 0)]
    assert [s.event_id for s in login.samples] == [1, 2, 3, 4, 5] and login.baseline.status == "active"
    assert (idle.trend, idle.alerts, idle.samples, idle.baseline) == ([], [], [], None)


def test_case_diagnostics(spark):
    cases = spark.createDataFrame([("a", "CROSS_DOCUMENT"), ("b", "REFUSAL"), ("c", "CHITCHAT")], "case_key string, question_type string")
    evidence = spark.createDataFrame(
        [("a", 0, "CHUNK", 1, 1, 11, "x"), ("a", 1, "DOCUMENT", 2, None, None, "y"), ("a", 2, "CHUNK", 3, 1, 31, None), ("b", 0, "DOCUMENT", 7, None, None, "x")], EVIDENCE)
    before = spark.createDataFrame([("a", 1, 9, 1, 90), ("a", 12, 1, 1, 11), ("a", 40, 2, 1, 20), ("b", 1, 8, 1, 80)], RANKED)
    after = spark.createDataFrame([("a", 1, 2, 1, 20), ("a", 2, 1, 1, 11), ("a", 3, 2, 1, 21), ("b", 1, 8, 1, 80)], RANKED)
    gate = spark.createDataFrame([("a", "ABSTAIN", 0.5, 3, 0)], "case_key string, outcome string, top_score double, input_count int, injected_count int")
    parts = spark.createDataFrame([("a", 1, 90), ("a", 1, 11), ("a", 2, None)], "case_key string, sub_no int, chunk_id long")
    a, b, c = ev.case_diagnostics(cases, evidence, before, after, gate, parts).orderBy("case_key").collect()
    assert (a.rerank_before_rank, a.rerank_after_rank, a.candidate_count, a.dual_hit, a.group_coverage) == (12, 1, 3, True, False)
    assert (a.candidate_hit_at10, a.candidate_hit_at30, a.candidate_hit_at50) == (False, True, True)
    assert (a.final_documents, a.final_chunks) == ([2, 1], [20, 11, 21])
    assert [tuple(g) for g in a.groups] == [("__solo_2", 0, 0, False), ("x", 12, 2, True), ("y", 40, 1, True)]
    assert [tuple(q) for q in a.sub_queries] == [(1, 2), (2, 0)] and (a.gate_outcome, a.gate_injected_count) == ("ABSTAIN", 0)
    assert (b.rerank_before_rank, b.dual_hit, b.group_coverage, b.gate_outcome, b.sub_queries) == (0, True, False, "INJECT", None)
    assert (c.candidate_count, c.dual_hit, c.groups, c.final_chunks) == (0, False, [], [])
    none = ev.case_diagnostics(cases, evidence.limit(0), before.limit(0), after.limit(0))
    assert {(r.rerank_after_rank, r.dual_hit) for r in none.collect()} == {(0, False)}


def test_question_evidence(spark):
    catalog, buckets, alerts, events, links, window = tables(spark)
    rules = [Rule("expr_praise", "Praise", 10, ["good"]), Rule("expr_complaint", "Complaint", 20, ["bad"])]
    marks = events.select("ws", "event_id", "occurred_at", F.lit("expr_praise").alias("expression"))
    cells = spark.createDataFrame([(1, 2, "login", [7, 1]), (1, 1, "login", [8, 7, 4])], "ws long, cell_no long, canonical_key string, sample_event_ids array<long>")
    facts = iv.evidence_facts(catalog, buckets, alerts, cells, events, marks, links, window, F.lit(at(2)), rules)
    asked = spark.createDataFrame(
        [(1, 1, "login", "expr_praise"), (2, 1, "idle", "expr_complaint"), (3, 1, "gone", None), (4, 2, None, "expr_other"), (5, None, None, None)],
        "question_id long, ws long, canonical_key string, expression string",
    )
    names = list(iv.TOOL_TITLES)
    tools = asked.select("question_id", F.posexplode(F.array(*[F.lit(t) for t in names])).alias("tool_pos", "tool"))
    rows = iv.question_evidence(asked, tools, catalog, facts, rules).collect()
    assert len(rows) == 5 * len(names)
    said = {(r.question_id, r.tool): r for r in rows}
    text = lambda q, tool: (said[q, tool].reference, said[q, tool].content, said[q, tool].sufficient)
    assert text(1, "ISSUE_TREND") == ("trend:login:last_14_days", "来源 issue_metric_bucket；Login 最近7天 4 条，前7天 6 条。", True)
    assert text(2, "ISSUE_TREND")[1:] == ("来源 issue_metric_bucket；Idle 最近7天 0 条，前7天 0 条。", True)
    assert text(3, "ISSUE_TREND") == ("trend:unresolved", iv.TREND_NEEDS_TOPIC, False)
    assert text(1, "TOPIC_DISTRIBUTION")[1] == "来源 issue_metric_bucket；最近7天 Top5：Login 4 条。"
    assert text(4, "TOPIC_DISTRIBUTION")[1:] == (iv.NO_TOPICS, False)
    assert text(1, "EXPRESSION_DISTRIBUTION")[1] == "来源 feedback_projection_annotation；分析窗口 2024-01-29T00:00Z 至 2024-01-31T00:00:00.005Z；L2 表达分布：Praise 8 条。"
    assert text(4, "EXPRESSION_DISTRIBUTION")[1:] == (iv.NO_EXPRESSIONS, False)
    # Links are counted as they are: each event is linked twice here.
    assert text(1, "EXPRESSION_TOPIC_DRILLDOWN")[1].endswith("：Login 16 条。")
    assert text(2, "EXPRESSION_TOPIC_DRILLDOWN") == ("expression:topics:expr_complaint", "Complaint" + iv.NO_DRILLDOWN, False)
    assert text(1, "EXPRESSION_TOPIC_SAMPLES")[1] == "来源 feedback_event；Praise × Login 样本：t1；" + "x" * 200 + "…；t5"
    assert text(3, "EXPRESSION_TOPIC_SAMPLES")[:2] == ("expression:samples:unresolved", iv.CROSS_NEEDS_EXPRESSION)
    assert text(4, "EXPRESSION_TOPIC_SAMPLES")[:2] == ("expression:samples:topic_unresolved", iv.CROSS_NEEDS_TOPIC)
    assert text(2, "EXPRESSION_TOPIC_SAMPLES")[1] == "Complaint × Idle" + iv.NO_CROSS_SAMPLES
    lines = "；".join(f"Login 当前值 {4 + i}、EWMA 1.3、z-score 2.0、状态 ACTIVE" for i in (6, 5, 4, 3, 2))
    assert text(1, "ALERT_HISTORY") == ("alerts:login", f"来源 alert；{lines}。", True)
    assert text(3, "ALERT_HISTORY") == ("alerts:recent", f"来源 alert；{lines}。", True)
    assert text(2, "ALERT_HISTORY") == ("alerts:recent", iv.NO_ALERTS, False) and said[2, "ALERT_HISTORY"].title == iv.NO_ALERT_TITLE
    assert text(1, "SAMPLE_FEEDBACK")[1] == "来源 feedback_event；样本：t8；t7；" + "x" * 200 + "…；t1"
    assert text(2, "SAMPLE_FEEDBACK")[:2] == ("samples:idle", iv.NO_TOPIC_SAMPLES)
    assert text(1, "PERIOD_COMPARISON") == ("comparison:login:last_14_days", "来源 issue_metric_bucket；Login 最近7天 4 条，前7天 6 条，绝对变化 -2 条。", True)
    assert text(2, "PERIOD_COMPARISON") == ("comparison:last_14_days", "Idle" + iv.NO_PERIODS, False)
    assert text(3, "PERIOD_COMPARISON")[0] == "comparison:workspace:last_14_days"
    assert text(5, "PERIOD_COMPARISON")[1] == iv.WHOLE_WORKSPACE + iv.NO_PERIODS
    assert text(1, "DATA_AVAILABILITY")[1:] == (iv.NO_VERSION_DATA, False)
