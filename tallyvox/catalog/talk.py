"""Conversations and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvox.catalog import inputs as src
from tallyvox.catalog.base import query
from tallyvox.catalog.inputs import AS_OF, CTES, with_tables
from tallyvox.operators import conversations as cv
from tallyvox.operators import investigation as iv
from tallyvox.sources.rule_tables import Rule

_INTENT = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in cv.INTENTS
) + " ELSE 'GENERAL_INQUIRY' END"
_TOOLS = ", ".join(f"('{i}', {p}, '{t}')" for i, tools in cv.TOOLS.items() for p, t in enumerate(tools))
_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@query("intent_route", with_tables(f"""
SELECT q.question_id, q.intent, t.tool_pos::BIGINT AS tool_pos, t.tool FROM (SELECT question_id, {_INTENT} AS intent FROM t_questions) q
JOIN (VALUES {_TOOLS}) t(intent, tool_pos, tool) ON t.intent = q.intent"""))
def _(spark, sf):
    return cv.intent_route(src.questions(spark, sf))


CTES["t_last_turns"] = f"""
SELECT session_id, {_TRIM.format("max_by(CASE seq % 3 WHEN 0 THEN '玩家问' || content || ' v2.5 的说明？' WHEN 1 THEN content || ' 近14天怎么样' ELSE content || ' 2024-5 是' END, seq)")} AS t
FROM t_messages WHERE role = 'user' GROUP BY session_id"""
_CUT = rf"""
WITH a AS (SELECT session_id, t, nullif(regexp_extract(t, '(?i)\bv?(\d+(?:\.\d+)+)\b', 1), '') AS version, {_TRIM.format("CASE WHEN starts_with(t, '玩家问') THEN substring(t, 4) ELSE t END")} AS x FROM t_last_turns),
b AS (SELECT *, {_TRIM.format("regexp_replace(x, '(的相关说明是什么|的相关说明|的说明是什么|的说明)[?？]?$', '')")} AS y FROM a),
c AS (SELECT *, CASE WHEN version IS NULL THEN y ELSE {_TRIM.format("regexp_replace(replace(replace(y, 'v' || version, ' '), version, ' '), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')")} END AS z FROM b),
d AS (SELECT *, {_TRIM.format("regexp_replace(" + _TRIM.format("regexp_replace(z, '(是什么|有哪些|怎么.*|为什么.*|几点.*|多少.*|吗|呢)[?？]?$', '')") + ", '是$', '')")} AS w FROM c)
SELECT session_id, CASE WHEN w = '' THEN version WHEN length(w) > 48 THEN {_TRIM.format('substring(w, 1, 48)')} ELSE w END AS topic,
       CASE WHEN regexp_matches(t, '近\d+天') THEN regexp_extract(t, '近\d+天') WHEN regexp_matches(t, '\d{{4}}[-/年]\d{{1,2}}')
            THEN regexp_extract(t, '(\d{{4}})[-/年]\d{{1,2}}', 1) || '年' || regexp_extract(t, '\d{{4}}[-/年](\d{{1,2}})', 1) || '月' END AS time_window, version FROM d"""
CTES["t_focus"] = _CUT


def turns(spark, sf):
    s, c = F.col("seq") % 3, F.col("content")
    marked = (
        F.when(s == 0, F.concat(F.lit("玩家问"), c, F.lit(" v2.5 的说明？")))
        .when(s == 1, F.concat(c, F.lit(" 近14天怎么样")))
        .otherwise(F.concat(c, F.lit(" 2024-5 是")))
    )
    return src.messages(spark, sf).withColumn("content", marked)


@query("focus_extract", with_tables("SELECT session_id, topic, time_window, version FROM t_focus"))
def _(spark, sf):
    return cv.focus_extract(turns(spark, sf))


_SUBJECT = " OR ".join(f"contains(lower(t), '{w}')" for w in cv.SUBJECT_WORDS)
_PRONOUN = " OR ".join(f"contains(t, '{w}')" for w in cv.PRONOUNS)
_CONTINUE = " OR ".join(f"contains(t, '{w}')" for w in cv.CONTINUATIONS)
_ELLIPTIC = " OR ".join(f"starts_with(t, '{w}') OR ends_with(t, '{w}')" for w in cv.ELLIPTICAL)
_SUBSTITUTED = "CASE " + " ".join(
    f"WHEN contains(t, '{w}') THEN substring(t, 1, instr(t, '{w}') - 1) || anchor || substring(t, instr(t, '{w}') + {len(w)})" for w in cv.SUBSTITUTABLE
) + " ELSE anchor || ' ' || t END"


@query("follow_up_rewrite", with_tables(rf"""
WITH q AS (SELECT q.question_id, q.text AS t, concat_ws(' ', nullif(f.version, ''), nullif(f.topic, ''), nullif(f.time_window, '')) AS anchor FROM t_questions q LEFT JOIN t_focus f USING (session_id)),
r AS (SELECT *, CASE WHEN anchor = '' THEN 'focus_empty' WHEN regexp_matches(t, '\b[vV]?\d+(\.\d+)+\b|近\d+天|last_\d+_days|\d{{4}}[-/年]\d{{1,2}}') OR {_SUBJECT} THEN 'self_contained'
   WHEN NOT ({_PRONOUN} OR {_CONTINUE} OR (length(t) <= 15 AND ({_ELLIPTIC}))) THEN 'no_trigger' ELSE 'contextual_reference' END AS reason,
   CASE WHEN {_PRONOUN} THEN {_SUBSTITUTED} ELSE anchor || ' ' || t END AS composed FROM q)
SELECT question_id, CASE WHEN reason <> 'contextual_reference' THEN t WHEN length(composed) > 120 THEN {_TRIM.format('substring(composed, 1, 120)')} ELSE composed END AS rewritten,
       reason = 'contextual_reference' AS triggered, reason FROM r"""))
def _(spark, sf):
    return cv.follow_up_rewrite(src.questions(spark, sf), cv.focus_extract(turns(spark, sf)))


_COMPACT = rf"""CASE WHEN role = 'assistant' THEN CASE WHEN length(k) <= 300 THEN k ELSE substring(k, 1, 300) || '…' END
  ELSE CASE WHEN length(content) <= 500 THEN content ELSE substring(content, 1, 500) || '…' END END"""
CTES["t_compact"] = rf"""
SELECT session_id, seq, role, {_COMPACT} AS compact FROM (SELECT *, CASE WHEN contains(content, '## 结论') THEN
    {_TRIM.format(r"CASE WHEN contains(rest, chr(10) || '## ') THEN substring(rest, 1, instr(rest, chr(10) || '## ') - 1) ELSE rest END")} ELSE content END AS k
  FROM (SELECT *, regexp_replace(substring(content, instr(content, '## 结论') + 5), '^\s+', '') AS rest
        FROM (SELECT session_id, seq, role, CASE WHEN seq % 2 = 1 THEN content || chr(10) || '## 结论' || chr(10) || content || chr(10) || '## 附录 x' ELSE content END AS content FROM t_messages) m) n) o"""


def headed(spark, sf):
    c = F.col("content")
    long = F.concat(c, F.lit("\n## 结论\n"), c, F.lit("\n## 附录 x"))
    return src.messages(spark, sf).withColumn("content", F.when(F.col("seq") % 2 == 1, long).otherwise(c))


@query("compact_message", with_tables("SELECT session_id, seq, compact FROM t_compact"))
def _(spark, sf):
    return headed(spark, sf).select(
        "session_id", "seq", cv.compact_message(F.col("role"), F.col("content")).alias("compact")
    )


# Conversations are short, so the recent window is two messages here.
CTES["t_segments"] = f"""
SELECT session_id, seq, CASE WHEN length(l) > 80 THEN {_TRIM.format('substring(l, 1, 80)')} || '…' ELSE l END AS line, n, r
FROM (SELECT session_id, seq, {_TRIM.format("role || ': ' || compact")} AS l, count(*) OVER (PARTITION BY session_id) AS n,
             row_number() OVER (PARTITION BY session_id ORDER BY seq) AS r FROM t_compact) q"""


@query("rolling_summary", with_tables(f"""
SELECT session_id, CASE WHEN length(s) <= 300 THEN s ELSE {_TRIM.format('substring(s, 1, 300)')} || '…' END AS summary
FROM (SELECT session_id, string_agg(line, '；' ORDER BY seq) AS s FROM t_segments WHERE n > 2 AND r <= n - 2 GROUP BY session_id) q"""))
def _(spark, sf):
    return cv.rolling_summary(headed(spark, sf), recent=2, cap=300)


@query("extend_summary", with_tables(f"""
SELECT session_id, CASE WHEN length(s) <= 600 THEN s ELSE {_TRIM.format('substring(s, 1, 600)')} || '…' END AS summary
FROM (SELECT session_id, string_agg(line, '；' ORDER BY seq) AS s FROM t_segments WHERE n > 1 AND r <= n - 1 GROUP BY session_id) q"""))
def _(spark, sf):
    rows = headed(spark, sf)
    saved = cv.rolling_summary(rows, recent=2)
    sizes = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    from tallyvox.operators.dashboard import ranked

    last_two = ranked(rows, 2, [F.desc("seq")], "session_id").filter("rank = 2").drop("rank")
    evicted = last_two.join(sizes.filter("n > 1"), "session_id", "left_semi")
    return cv.extend_summary(saved, evicted)


@query("run_latency_baseline", with_tables("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY created_at DESC, run_id DESC) AS k FROM t_runs)
SELECT ws, agent_type, prompt_version, model_name, count(*) AS samples, quantile_disc(latency_ms, 0.5) AS latency_p50, quantile_disc(latency_ms, 0.95) AS latency_p95,
       CASE WHEN count(prompt_tokens) = count(*) THEN quantile_disc(prompt_tokens, 0.5) END AS prompt_p50, CASE WHEN count(prompt_tokens) = count(*) THEN quantile_disc(prompt_tokens, 0.95) END AS prompt_p95,
       quantile_disc(completion_tokens, 0.5) AS completion_p50, quantile_disc(completion_tokens, 0.95) AS completion_p95
FROM n WHERE k <= 100 AND status = 'succeeded' GROUP BY ws, agent_type, prompt_version, model_name"""))
def _(spark, sf):
    return cv.run_latency_baseline(src.runs(spark, sf))


# Questions name topics by parts of words, so that the given texts reach every tool.
_ASKED_TOPICS = [("error", "heit"), ("payment", "tion"), ("click", "eron the"), ("refund", "und")]
_ASKED_EXPRESSIONS = [Rule("expr_suggestion", "Sugg/建议", 40, ["趋势"]), Rule("expr_complaint", "Bad/ung", 30, ["que"]), Rule("expr_praise", "Good", 20, ["est"])]
_SHOWN = "CASE {} WHEN 'expr_suggestion' THEN 'Sugg/建议' WHEN 'expr_complaint' THEN 'Bad/ung' WHEN 'expr_praise' THEN 'Good' ELSE '其他' END"
_ISO = """strftime({0}, '%Y-%m-%dT%H:%M') || CASE WHEN epoch_us({0}) % 60000000 = 0 THEN '' WHEN epoch_us({0}) % 1000000 = 0 THEN strftime({0}, ':%S')
  WHEN epoch_us({0}) % 1000 = 0 THEN strftime({0}, ':%S.%g') ELSE strftime({0}, ':%S.%f') END || 'Z'"""
_SPAN = _ISO.format("w.w0") + " || ' 至 ' || " + _ISO.format("w.w1")
_CAPPED = "CASE WHEN length(e.sanitized_text) <= 200 THEN e.sanitized_text ELSE substring(e.sanitized_text, 1, 200) || '…' END"
_ALERT = "coalesce(c.canonical_name, '未知主题') || ' 当前值 ' || a.current_count || '、EWMA ' || printf('%.1f', round(a.ewma, 1)) || '、z-score ' || printf('%.1f', round(a.z_score, 1)) || '、状态 ' || a.status"
_COUNTS = "' 最近7天 ' || cur || ' 条，前7天 ' || prev || ' 条'"
CTES["t_two_weeks"] = f"""
SELECT c.ws, c.canonical_key, c.canonical_name, CAST(coalesce(sum(b.feedback_count) FILTER (b.bucket_start >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY), 0) AS BIGINT) AS cur,
       CAST(coalesce(sum(b.feedback_count) FILTER (b.bucket_start < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY), 0) AS BIGINT) AS prev
FROM t_catalog c LEFT JOIN t_buckets b ON b.ws = c.ws AND b.canonical_key = c.canonical_key AND b.bucket_start >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND b.bucket_start < TIMESTAMP '{AS_OF}'
GROUP BY ALL"""
CTES["t_tool_facts"] = f"""
SELECT 'ISSUE_TREND' AS tool, ws, canonical_key AS topic, '' AS expression, '来源 issue_metric_bucket；' || canonical_name || {_COUNTS} || '。' AS content FROM t_two_weeks
UNION ALL SELECT 'TOPIC_DISTRIBUTION', ws, '', '', '来源 issue_metric_bucket；最近7天 Top5：' || string_agg(canonical_name || ' ' || cur || ' 条', '；' ORDER BY cur DESC, canonical_key) || '。'
  FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY cur DESC, canonical_key) AS n FROM t_two_weeks WHERE cur > 0) q WHERE n <= 5 GROUP BY ws
UNION ALL SELECT 'EXPRESSION_DISTRIBUTION', ws, '', '', '来源 feedback_projection_annotation；分析窗口 ' || {_SPAN} || '；L2 表达分布：' || x.t || '。' FROM t_window w JOIN (
  SELECT ws, string_agg({_SHOWN.format('expression')} || ' ' || n || ' 条', '；' ORDER BY pos) AS t FROM (SELECT a.ws, l.pos, l.expression, count(*) AS n FROM t_window_annotations a
    JOIN (VALUES ('expr_suggestion', 1), ('expr_complaint', 2), ('expr_praise', 3), ('expr_other', 4)) l(expression, pos) USING (expression) GROUP BY ALL) q GROUP BY ws) x USING (ws)
UNION ALL SELECT 'EXPRESSION_TOPIC_DRILLDOWN', ws, '', expression, '来源 annotation ⋈ issue_link；' || {_SHOWN.format('expression')} || '（' || expression || '）下 Top5 议题；分析窗口 ' || {_SPAN} || '：' || x.t || '。' FROM t_window w JOIN (
  SELECT ws, expression, string_agg(upper(canonical_key) || ' ' || n || ' 条', '；' ORDER BY n DESC, canonical_key) AS t FROM (
    SELECT a.ws, a.expression, l.canonical_key, count(*) AS n, row_number() OVER (PARTITION BY a.ws, a.expression ORDER BY count(*) DESC, l.canonical_key) AS r
    FROM t_window_annotations a JOIN t_links l USING (event_id) GROUP BY a.ws, a.expression, l.canonical_key) q WHERE r <= 5 GROUP BY ws, expression) x USING (ws)
UNION ALL SELECT 'EXPRESSION_TOPIC_SAMPLES', ws, canonical_key, expression, '来源 feedback_event；' || {_SHOWN.format('expression')} || ' × ' || upper(canonical_key) || ' 样本：' || string_agg(s, '；' ORDER BY event_id) FROM (
    SELECT a.ws, l.canonical_key, a.expression, a.event_id, {_CAPPED} AS s, row_number() OVER (PARTITION BY a.ws, a.expression, l.canonical_key ORDER BY a.event_id) AS r
    FROM t_window_annotations a JOIN t_links l USING (event_id) JOIN t_events e USING (event_id)) q WHERE r <= 5 GROUP BY ws, canonical_key, expression
UNION ALL SELECT 'ALERT_HISTORY', ws, canonical_key, '', '来源 alert；' || string_agg(t, '；' ORDER BY created_at DESC, alert_id DESC) || '。' FROM (
    SELECT a.ws, a.canonical_key, a.created_at, a.alert_id, {_ALERT} AS t, row_number() OVER (PARTITION BY a.ws, a.canonical_key ORDER BY a.created_at DESC, a.alert_id DESC) AS r
    FROM t_alerts a JOIN t_catalog c USING (ws, canonical_key)) q WHERE r <= 5 GROUP BY ws, canonical_key
UNION ALL SELECT 'ALERT_HISTORY', ws, '', '', '来源 alert；' || string_agg(t, '；' ORDER BY created_at DESC, alert_id DESC) || '。' FROM (
    SELECT a.ws, a.created_at, a.alert_id, {_ALERT} AS t, row_number() OVER (PARTITION BY a.ws ORDER BY a.created_at DESC, a.alert_id DESC) AS r
    FROM t_alerts a LEFT JOIN t_catalog c USING (ws, canonical_key)) q WHERE r <= 5 GROUP BY ws
UNION ALL SELECT 'SAMPLE_FEEDBACK', ws, canonical_key, '', '来源 feedback_event；样本：' || string_agg(s, '；' ORDER BY r) FROM (
    SELECT i.ws, i.canonical_key, {_CAPPED} AS s, row_number() OVER (PARTITION BY i.ws, i.canonical_key ORDER BY i.cell_no, i.pos) AS r
    FROM (SELECT ws, canonical_key, cell_no, unnest(sample_event_ids) AS event_id, generate_subscripts(sample_event_ids, 1) AS pos FROM t_cell_issues) i JOIN t_events e USING (event_id)) q WHERE r <= 5 GROUP BY ws, canonical_key
UNION ALL SELECT 'PERIOD_COMPARISON', ws, canonical_key, '', '来源 issue_metric_bucket；' || canonical_name || {_COUNTS} || '，绝对变化 ' || printf('%+d', cur - prev) || ' 条。' FROM t_two_weeks WHERE cur <> 0 OR prev <> 0
UNION ALL SELECT 'PERIOD_COMPARISON', ws, '', '', '来源 issue_metric_bucket；全工作区主题聚合' || {_COUNTS} || '，绝对变化 ' || printf('%+d', cur - prev) || ' 条。'
  FROM (SELECT ws, CAST(sum(cur) AS BIGINT) AS cur, CAST(sum(prev) AS BIGINT) AS prev FROM t_two_weeks GROUP BY ws) q WHERE cur <> 0 OR prev <> 0"""


@query("question_evidence", with_tables(f"""
WITH m AS (SELECT question_id, session_id % 4 AS ws, {_INTENT} AS intent, CASE WHEN contains(lower(text), 'eron the') OR contains(lower(text), 'click') THEN 'click' WHEN contains(lower(text), 'heit') OR contains(lower(text), 'error') THEN 'error'
    WHEN contains(lower(text), 'tion') OR contains(lower(text), 'payment') THEN 'payment' WHEN contains(lower(text), 'und') OR contains(lower(text), 'refund') THEN 'refund' END AS canonical_key,
    coalesce(CASE WHEN contains(lower(text), 'sugg') OR contains(text, '建议') THEN 'expr_suggestion' WHEN contains(lower(text), 'bad') OR contains(lower(text), 'ung') THEN 'expr_complaint' WHEN contains(lower(text), 'good') THEN 'expr_praise'
      WHEN contains(text, '其他') THEN 'expr_other' WHEN contains(text, '趋势') THEN 'expr_suggestion' WHEN contains(lower(text), 'que') THEN 'expr_complaint' WHEN contains(lower(text), 'est') THEN 'expr_praise' END, '') AS e FROM t_questions),
a AS (SELECT m.question_id, m.ws, t.tool_pos, t.tool, m.e, coalesce(c.canonical_key, '') AS k, c.canonical_name AS name FROM m JOIN (VALUES {_TOOLS}) t(intent, tool_pos, tool) USING (intent) LEFT JOIN t_catalog c USING (ws, canonical_key)),
j AS (SELECT a.*, f.content, f.content IS NOT NULL AS has FROM a LEFT JOIN t_tool_facts f ON f.tool = a.tool AND f.ws = a.ws
      AND f.topic = CASE WHEN a.tool IN ('ISSUE_TREND', 'ALERT_HISTORY', 'SAMPLE_FEEDBACK', 'PERIOD_COMPARISON', 'EXPRESSION_TOPIC_SAMPLES') THEN a.k ELSE '' END
      AND f.expression = CASE WHEN a.tool IN ('EXPRESSION_TOPIC_DRILLDOWN', 'EXPRESSION_TOPIC_SAMPLES') THEN a.e ELSE '' END)
SELECT question_id, tool_pos::BIGINT AS tool_pos, tool, has AS sufficient,
  CASE tool WHEN 'ISSUE_TREND' THEN CASE WHEN has THEN 'trend:' || k || ':last_14_days' ELSE 'trend:unresolved' END WHEN 'TOPIC_DISTRIBUTION' THEN 'distribution:last_7_days' WHEN 'EXPRESSION_DISTRIBUTION' THEN 'expression:distribution'
    WHEN 'EXPRESSION_TOPIC_DRILLDOWN' THEN 'expression:topics:' || CASE WHEN e = '' THEN 'unresolved' ELSE e END
    WHEN 'EXPRESSION_TOPIC_SAMPLES' THEN 'expression:samples:' || CASE WHEN e = '' THEN 'unresolved' WHEN k = '' THEN 'topic_unresolved' ELSE e || ':' || k END
    WHEN 'ALERT_HISTORY' THEN 'alerts:' || CASE WHEN has AND k <> '' THEN k ELSE 'recent' END WHEN 'SAMPLE_FEEDBACK' THEN 'samples:' || CASE WHEN k = '' THEN 'unresolved' ELSE k END
    WHEN 'PERIOD_COMPARISON' THEN CASE WHEN has THEN 'comparison:' || CASE WHEN k = '' THEN 'workspace' ELSE k END || ':last_14_days' ELSE 'comparison:last_14_days' END ELSE 'availability:version_event' END AS reference,
  CASE tool WHEN 'ISSUE_TREND' THEN '主题趋势' WHEN 'TOPIC_DISTRIBUTION' THEN '主题分布' WHEN 'EXPRESSION_DISTRIBUTION' THEN 'L2 表达分布' WHEN 'EXPRESSION_TOPIC_DRILLDOWN' THEN 'L2→L1 交叉分布' WHEN 'EXPRESSION_TOPIC_SAMPLES' THEN 'L2×L1 脱敏样本'
    WHEN 'ALERT_HISTORY' THEN CASE WHEN has THEN '告警与基线' ELSE '告警历史' END WHEN 'SAMPLE_FEEDBACK' THEN '脱敏样本' WHEN 'PERIOD_COMPARISON' THEN '时间范围比较' ELSE '版本数据可用性' END AS title,
  coalesce(content, CASE tool WHEN 'ISSUE_TREND' THEN '未识别具体主题，无法查询单主题趋势。' WHEN 'TOPIC_DISTRIBUTION' THEN '最近7天没有可用的主题聚合数据。' WHEN 'EXPRESSION_DISTRIBUTION' THEN '当前分析窗口内没有可用的 L2 表达标注数据。'
    WHEN 'EXPRESSION_TOPIC_DRILLDOWN' THEN CASE WHEN e = '' THEN '未识别具体 L2 表达类型（如建议/吐槽/好评），无法查询交叉议题分布。' ELSE {_SHOWN.format('e')} || ' 在当前分析窗口内没有可关联的 L1 议题数据。' END
    WHEN 'EXPRESSION_TOPIC_SAMPLES' THEN CASE WHEN e = '' THEN '未识别具体 L2 表达类型，无法安全抽取交叉样本。' WHEN k = '' THEN '未识别具体 L1 主题，无法安全抽取 L2×L1 交叉样本。' ELSE {_SHOWN.format('e')} || ' × ' || name || ' 没有可用的脱敏反馈样本。' END
    WHEN 'ALERT_HISTORY' THEN '当前查询范围内没有告警记录。' WHEN 'SAMPLE_FEEDBACK' THEN CASE WHEN k = '' THEN '未识别具体主题，无法安全抽取反馈样本。' ELSE '当前主题没有可用的脱敏反馈样本。' END
    WHEN 'PERIOD_COMPARISON' THEN coalesce(name, '全工作区主题聚合') || ' 在最近14天没有可比较的指标数据。' ELSE '当前未接入版本或活动事件数据，不能确认版本前后变化，更不能据此判断因果。' END) AS content FROM j"""))
def _(spark, sf):
    """Every turn of a conversation as a question to one of four workspaces."""
    questions = src.questions(spark, sf).withColumn("ws", F.col("session_id") % 4)
    named = iv.question_topic_match(questions, _ASKED_TOPICS, _ASKED_EXPRESSIONS)
    asked = questions.select("question_id", "ws").join(named, "question_id")
    tools = cv.intent_route(questions).select("question_id", "tool_pos", "tool")
    catalog = src.topic_catalog(spark, sf)
    facts = iv.evidence_facts(
        catalog, src.buckets(spark, sf), src.alerts(spark, sf), src.issues_of_cells(spark, sf), src.feedback(spark, sf),
        src.annotations(spark, sf), src.links(spark, sf).select("event_id", "canonical_key"), src.window(spark, sf),
        src.as_of(), _ASKED_EXPRESSIONS,
    )
    return iv.question_evidence(asked, tools, catalog, facts, _ASKED_EXPRESSIONS)
