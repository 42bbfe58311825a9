"""Conversation history, follow-up questions, intents, run latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.questions import VERSION_PATTERN, YEAR_MONTH
from tallyvox.functions.text import bind, cap_text, contains_any, java_trim
from tallyvox.operators.dashboard import ranked

# Intents by keyword, in order, and the tools of each intent.
INTENTS = [
    ("REPORT_GENERATION", ["周报", "日报", "专题报告", "生成报告", "报告"]),
    ("VERSION_COMPARISON", ["版本", "上线", "更新前后", "版本前后"]),
    ("PERIOD_COMPARISON", ["环比", "同比", "对比", "上周", "本周", "上一周期"]),
    ("ANOMALY_INVESTIGATION", ["暴增", "异常", "告警", "为什么", "原因", "激增"]),
    ("TREND_EXPLANATION", ["趋势", "变化", "走势", "增长", "下降"]),
    ("EXPRESSION_INQUIRY", [
        "吐槽", "建议", "好评", "差评", "表达分布", "表达占比", "情绪分布", "玩家诉求", "体验分享",
        "不满分布", "诉求分布", "好评议题", "差评议题", "吐槽议题", "建议议题", "表达层", "l2",
    ]),
]
OTHER_INTENT = "GENERAL_INQUIRY"
TOOLS = {
    "TREND_EXPLANATION": ["ISSUE_TREND"],
    "ANOMALY_INVESTIGATION": ["ISSUE_TREND", "ALERT_HISTORY", "SAMPLE_FEEDBACK"],
    "PERIOD_COMPARISON": ["ISSUE_TREND", "PERIOD_COMPARISON"],
    "VERSION_COMPARISON": ["ISSUE_TREND", "PERIOD_COMPARISON", "DATA_AVAILABILITY"],
    "REPORT_GENERATION": [
        "EXPRESSION_DISTRIBUTION", "TOPIC_DISTRIBUTION", "ALERT_HISTORY", "ISSUE_TREND",
    ],
    "EXPRESSION_INQUIRY": [
        "EXPRESSION_DISTRIBUTION", "EXPRESSION_TOPIC_DRILLDOWN", "EXPRESSION_TOPIC_SAMPLES",
    ],
    "GENERAL_INQUIRY": ["TOPIC_DISTRIBUTION"],
}

# Follow-up questions.
PRONOUNS = ["它", "这个", "那个", "这些", "上面", "刚才", "里面", "其中"]
SUBSTITUTABLE = ["里面", "其中", "上面", "刚才", "这些", "这个", "那个", "它"]
CONTINUATIONS = ["继续", "再看看", "展开说说"]
ELLIPTICAL = ["为什么", "怎么", "多少", "呢", "还有"]
SUBJECT_WORDS = [
    "版本", "更新", "公告", "登录", "结算", "背包", "奖励", "维护", "工单", "玩家", "异常", "故障",
    "bug", "舆情", "活动", "停服", "渠道", "复盘", "事故", "客服", "sop", "release", "玩法", "反馈",
]
TIME_WINDOW = r"近\d+天|last_\d+_days"
ELLIPTICAL_CHARS = 15
REWRITE_CHARS = 120

# What is cut off a question to get its topic.
QUESTION_LEAD = "玩家问"
FILLER_SUFFIX = r"(的相关说明是什么|的相关说明|的说明是什么|的说明)[?？]?$"
QUESTION_SUFFIX = r"(是什么|有哪些|怎么.*|为什么.*|几点.*|多少.*|吗|呢)[?？]?$"
TOPIC_CHARS = 48

# History limits and headings.
USER_CHARS = 500
ASSISTANT_CHARS = 300
CONCLUSION_HEADING = "## 结论"
NEXT_SECTION = "\n## "
RECENT_MESSAGES = 12
SUMMARY_CHARS = 600
LINE_CHARS = 80
SEPARATOR = "；"


def intent_of(question: Column) -> Column:
    def first(text: Column) -> Column:
        result = F.lit(OTHER_INTENT)
        for name, words in reversed(INTENTS):
            result = F.when(contains_any(text, words), F.lit(name)).otherwise(result)
        return result

    return bind(F.lower(F.coalesce(question, F.lit(""))), first)


def intent_route(questions: DataFrame) -> DataFrame:
    """One row per question and evidence tool, in tool order."""
    tools = F.create_map(
        *[x for name, t in TOOLS.items() for x in (F.lit(name), F.array(*[F.lit(v) for v in t]))]
    )
    routed = questions.withColumn("intent", intent_of(F.col("text")))
    return routed.select(
        "question_id", "intent", F.posexplode(tools[F.col("intent")]).alias("tool_pos", "tool")
    )


def version_label(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), VERSION_PATTERN, 1), F.lit(""))


def time_window(c: Column) -> Column:
    near = F.regexp_extract(c, r"近\d+天", 0)
    year, month = F.regexp_extract(c, YEAR_MONTH, 1), F.regexp_extract(c, YEAR_MONTH, 2)
    return F.when(near != "", near).when(
        year != "", F.concat(year, F.lit("年"), month, F.lit("月"))
    )


def topic_of(c: Column, version: Column) -> Column:
    text = java_trim(F.regexp_replace(java_trim(c), f"^{QUESTION_LEAD}", ""))
    text = java_trim(F.regexp_replace(text, FILLER_SUFFIX, ""))
    without = F.replace(F.replace(text, F.concat(F.lit("v"), version), F.lit(" ")), version, F.lit(" "))
    text = F.when(version.isNotNull(), java_trim(F.regexp_replace(without, r"\s+", " "))).otherwise(text)
    text = java_trim(F.regexp_replace(text, QUESTION_SUFFIX, ""))
    text = java_trim(F.regexp_replace(text, "是$", ""))
    cut = java_trim(F.substring(text, 1, TOPIC_CHARS))
    return bind(cut, lambda x: F.when(x == "", version).otherwise(x))


def focus_extract(messages: DataFrame) -> DataFrame:
    """Topic, time window and version of the last user turn; nothing for sessions without one."""
    users = messages.filter((F.lower("role") == "user") & F.col("content").isNotNull())
    last = users.groupBy("session_id").agg(java_trim(F.max_by("content", "seq")).alias("_last"))
    spoken = last.filter(F.col("_last") != "").withColumn("version", version_label(F.col("_last")))
    return spoken.select(
        "session_id",
        topic_of(F.col("_last"), F.col("version")).alias("topic"),
        time_window(F.col("_last")).alias("time_window"),
        "version",
    )


def _filled(c: Column) -> Column:
    return F.when(java_trim(c) != "", java_trim(c))


def follow_up_rewrite(questions: DataFrame, focus: DataFrame) -> DataFrame:
    """Follow-up questions completed from the session's focus, with the reason of the decision."""
    rows = questions.join(focus, "session_id", "left")
    text = F.coalesce("text", F.lit(""))
    version, topic, window = (_filled(F.col(c)) for c in ("version", "topic", "time_window"))
    anchor = F.concat_ws(" ", version, topic, window)
    self_contained = (
        version_label(text).isNotNull()
        | text.rlike(TIME_WINDOW)
        | text.rlike(YEAR_MONTH)
        | bind(F.lower(text), lambda t: contains_any(t, SUBJECT_WORDS))
    )
    pronoun = contains_any(text, PRONOUNS)
    elliptical = F.lit(False)
    for marker in ELLIPTICAL:
        elliptical = elliptical | text.startswith(marker) | text.endswith(marker)
    triggered = pronoun | contains_any(text, CONTINUATIONS) | (
        (F.length(text) <= ELLIPTICAL_CHARS) & elliptical
    )
    substituted = F.concat(anchor, F.lit(" "), text)
    for token in reversed(SUBSTITUTABLE):
        at = F.instr(text, token)
        replaced = F.concat(
            F.substring(text, F.lit(1), at - 1), anchor, F.substring(text, at + len(token), F.length(text))
        )
        substituted = F.when(at > 0, replaced).otherwise(substituted)
    composed = F.when(pronoun, substituted).otherwise(F.concat(anchor, F.lit(" "), text))
    capped = F.when(
        F.length(composed) > REWRITE_CHARS, java_trim(F.substring(composed, 1, REWRITE_CHARS))
    ).otherwise(composed)
    reason = (
        F.when(anchor == "", F.lit("focus_empty"))
        .when(self_contained, F.lit("self_contained"))
        .when(~triggered, F.lit("no_trigger"))
        .otherwise(F.lit("contextual_reference"))
    )
    done = reason == "contextual_reference"
    return rows.select(
        "question_id",
        F.when(done, capped).otherwise(text).alias("rewritten"),
        done.alias("triggered"),
        reason.alias("reason"),
    )


def compact_message(role: Column, content: Column) -> Column:
    """Questions cut at their limit; answers reduced to their conclusion section."""
    at = F.instr(content, CONCLUSION_HEADING)
    rest = F.regexp_replace(
        F.substring(content, at + len(CONCLUSION_HEADING), F.length(content)), r"^\s+", ""
    )
    following = F.instr(rest, NEXT_SECTION)
    body = F.when(following > 0, F.substring(rest, F.lit(1), following - 1)).otherwise(rest)
    conclusion = F.when(at > 0, java_trim(body)).otherwise(content)
    return F.when(role == "assistant", cap_text(conclusion, ASSISTANT_CHARS)).otherwise(
        cap_text(content, USER_CHARS)
    )


def _line(role: Column, content: Column) -> Column:
    line = java_trim(F.concat(role, F.lit(": "), compact_message(role, content)))
    return F.when(
        F.length(line) > LINE_CHARS,
        F.concat(java_trim(F.substring(line, 1, LINE_CHARS)), F.lit("…")),
    ).otherwise(line)


def rolling_summary(
    messages: DataFrame, recent: int = RECENT_MESSAGES, cap: int = SUMMARY_CHARS
) -> DataFrame:
    """Everything but the last messages of a session, as one capped line.

    Every segment has at least one character, so segments beyond the cap cannot show. That bounds
    what one session contributes, however many messages it has.
    """
    sizes = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    first = ranked(messages, recent + cap + 1, ["seq"], "session_id")
    older = first.join(sizes.filter(F.col("_n") > recent), "session_id").filter(
        F.col("rank") <= F.col("_n") - recent
    )
    segments = older.select(
        "session_id", "seq", _line(F.col("role"), F.col("content")).alias("line")
    )
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"]), SEPARATOR
    )
    return _capped(segments.groupBy("session_id").agg(joined.alias("_s")), cap)


def _capped(df: DataFrame, cap: int) -> DataFrame:
    text = java_trim(F.col("_s"))
    summary = F.when(F.length(text) <= cap, text).otherwise(
        F.concat(java_trim(F.substring(text, 1, cap)), F.lit("…"))
    )
    return df.select("session_id", summary.alias("summary"))


def extend_summary(
    summaries: DataFrame, evicted: DataFrame, cap: int = SUMMARY_CHARS
) -> DataFrame:
    """Incremental form: saved summary plus messages that just left the recent window."""
    lines = ranked(evicted, cap + 1, ["seq"], "session_id").select(
        "session_id", "seq", _line(F.col("role"), F.col("content")).alias("line")
    )
    added = lines.groupBy("session_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"]),
            SEPARATOR,
        ).alias("_new")
    )
    joined = summaries.join(added, "session_id", "full_outer").withColumn(
        "_s", F.concat_ws(SEPARATOR, _filled(F.col("summary")), _filled(F.col("_new")))
    )
    return _capped(joined.filter(F.col("_s") != ""), cap)


def run_latency_baseline(runs: DataFrame, n: int = 100) -> DataFrame:
    """Percentiles of the succeeded runs among the latest `n` of each workspace, per variant."""
    newest = ranked(runs, n, [F.desc("created_at"), F.desc("run_id")])
    good = newest.filter((F.col("status") == "succeeded") & F.col("latency_ms").isNotNull())
    everyone = F.count(F.lit(1))

    def disc(column: str, p: float, complete: bool) -> Column:
        value = F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").cast("bigint")
        return F.when(F.count(column) == everyone, value) if complete else value

    return good.groupBy("ws", "agent_type", "prompt_version", "model_name").agg(
        everyone.alias("samples"),
        disc("latency_ms", 0.5, False).alias("latency_p50"),
        disc("latency_ms", 0.95, False).alias("latency_p95"),
        disc("prompt_tokens", 0.5, True).alias("prompt_p50"),
        disc("prompt_tokens", 0.95, True).alias("prompt_p95"),
        disc("completion_tokens", 0.5, True).alias("completion_p50"),
        disc("completion_tokens", 0.95, True).alias("completion_p95"),
    )
