"""Investigation windows, evidence rows and summaries; matching questions to topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.text import bind, cap_text
from tallyvox.operators.dashboard import expression_distribution, expression_topic_samples, expression_topics, period_columns, ranked
from tallyvox.sources import fixed_rules as fixed
from tallyvox.sources.rule_tables import EXPRESSION_RULES, Rule

# Titles and texts of evidence rows.
ALERT_TITLE = "告警触发快照"
HISTORY_TITLE = "历史告警与基线"
TREND_TITLE = "主题趋势"
SAMPLE_TITLE = "脱敏样本"
COMPARISON_TITLE = "时间范围比较"
NO_HISTORY = "当前告警之前没有可复核的同主题告警记录。"
NO_TREND = "当前窗口没有可用日桶。"
NO_SAMPLE = "冻结窗口内没有可用的脱敏反馈样本；不使用窗口外样本补足。"
NO_COMPARISON = "冻结窗口内没有可比较的主题日指标。"

# Titles, texts and limits of the evidence a question gets from each tool.
TOOL_TITLES = {
    "ISSUE_TREND": "主题趋势",
    "TOPIC_DISTRIBUTION": "主题分布",
    "EXPRESSION_DISTRIBUTION": "L2 表达分布",
    "EXPRESSION_TOPIC_DRILLDOWN": "L2→L1 交叉分布",
    "EXPRESSION_TOPIC_SAMPLES": "L2×L1 脱敏样本",
    "ALERT_HISTORY": "告警与基线",
    "SAMPLE_FEEDBACK": "脱敏样本",
    "PERIOD_COMPARISON": "时间范围比较",
    "DATA_AVAILABILITY": "版本数据可用性",
}
NO_ALERT_TITLE = "告警历史"
WHOLE_WORKSPACE = "全工作区主题聚合"
TREND_NEEDS_TOPIC = "未识别具体主题，无法查询单主题趋势。"
SAMPLES_NEED_TOPIC = "未识别具体主题，无法安全抽取反馈样本。"
NO_TOPIC_SAMPLES = "当前主题没有可用的脱敏反馈样本。"
NO_TOPICS = "最近7天没有可用的主题聚合数据。"
NO_ALERTS = "当前查询范围内没有告警记录。"
NO_PERIODS = " 在最近14天没有可比较的指标数据。"
NO_EXPRESSIONS = "当前分析窗口内没有可用的 L2 表达标注数据。"
DRILLDOWN_NEEDS_EXPRESSION = "未识别具体 L2 表达类型（如建议/吐槽/好评），无法查询交叉议题分布。"
NO_DRILLDOWN = " 在当前分析窗口内没有可关联的 L1 议题数据。"
CROSS_NEEDS_EXPRESSION = "未识别具体 L2 表达类型，无法安全抽取交叉样本。"
CROSS_NEEDS_TOPIC = "未识别具体 L1 主题，无法安全抽取 L2×L1 交叉样本。"
NO_CROSS_SAMPLES = " 没有可用的脱敏反馈样本。"
NO_VERSION_DATA = "当前未接入版本或活动事件数据，不能确认版本前后变化，更不能据此判断因果。"
UNKNOWN_TOPIC = "未知主题"
EVIDENCE_TOP = 5
EVIDENCE_TEXT_CAP = 200

TITLE_CAP = 200
CONTENT_CAP = 4000

SELECTIONS = {"SHORT_TERM": ["SHORT_TERM"], "WEEKLY": ["WEEKLY"], "BOTH": ["SHORT_TERM", "WEEKLY"]}
WINDOW_DAYS = {"SHORT_TERM": 1, "WEEKLY": 7}


def _days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def investigation_windows(
    alerts: DataFrame, selection: str = "WEEKLY", anchor: str = "bucket_start"
) -> DataFrame:
    """Current window ends a day after the anchor; the previous one has the same length."""
    end = F.col(anchor) + _days(1)
    windows = []
    for name in SELECTIONS[selection]:
        span = WINDOW_DAYS[name]
        windows.append(
            F.struct(
                F.lit(name).alias("window_type"),
                (end - _days(span)).alias("current_start"),
                end.alias("current_end"),
                (end - _days(2 * span)).alias("previous_start"),
                (end - _days(span)).alias("previous_end"),
            )
        )
    return alerts.select("ws", "canonical_key", "alert_id", F.inline(F.array(*windows)))


def window_counts(windows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Current and previous sums and the daily series of each alert window.

    A window meets only its own days, on (workspace, topic, day).
    """
    days = buckets.select("ws", "canonical_key", "bucket_start", "feedback_count", F.to_date("bucket_start").alias("_day"))
    span = F.sequence(F.to_date("previous_start"), F.to_date("current_end"))
    joined = windows.withColumn("_day", F.explode(span)).join(days, ["ws", "canonical_key", "_day"], "left")
    at, n = F.col("bucket_start"), F.col("feedback_count")
    current = (at >= F.col("current_start")) & (at < F.col("current_end"))
    previous = (at >= F.col("previous_start")) & (at < F.col("previous_end"))
    keys = [
        "ws", "canonical_key", "alert_id", "window_type",
        "current_start", "current_end", "previous_start", "previous_end",
    ]
    return joined.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(current, n)), F.lit(0)).alias("current_count"),
        F.coalesce(F.sum(F.when(previous, n)), F.lit(0)).alias("previous_count"),
        F.array_sort(
            F.collect_list(F.when(current, F.struct("bucket_start", "feedback_count")))
        ).alias("series"),
    )


def _stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm'Z'")


def _describe() -> Column:
    return F.concat(
        F.lit("windowType="), F.col("window_type"),
        F.lit("，currentStart="), _stamp(F.col("current_start")),
        F.lit("，currentEnd="), _stamp(F.col("current_end")),
        F.lit("，previousStart="), _stamp(F.col("previous_start")),
        F.lit("，previousEnd="), _stamp(F.col("previous_end")),
    )


def evidence_rows(
    alerts: DataFrame,
    history: DataFrame,
    windows: DataFrame,
    buckets: DataFrame,
    samples: DataFrame,
) -> DataFrame:
    """Alert snapshot, history, and per window trend, samples and comparison, as one table.

    `samples(ws, canonical_key, alert_id, window_type, texts)` holds at most a handful of texts.
    """
    columns = ["ws", "alert_id", "source_type", "reference", "title", "content", "sufficient"]
    snapshot = alerts.select(
        "ws",
        "alert_id",
        F.lit("ALERT").alias("source_type"),
        F.col("alert_id").cast("string").alias("reference"),
        F.lit(ALERT_TITLE).alias("title"),
        F.format_string(
            "触发时间=%s；当前值=%d；EWMA=%.2f；标准差=%.2f；z-score=%.2f；生效阈值=%d；状态=%s",
            _stamp(F.col("bucket_start")), "current_count", "ewma", "std", "z_score",
            "effective_threshold", "status",
        ).alias("content"),
        F.lit(True).alias("sufficient"),
    )
    lines = F.transform(
        "history",
        lambda h: F.concat(
            _stamp(h["bucket_start"]), F.lit(": 当前值 "), h["current_count"].cast("string"),
            F.lit("，z-score "), F.format_string("%.1f", h["z_score"]),
            F.lit("，状态 "), h["status"],
        ),
    )
    earlier = history.select(
        "ws",
        "alert_id",
        F.lit("ALERT_HISTORY").alias("source_type"),
        F.concat(F.lit("alerts:"), F.col("canonical_key")).alias("reference"),
        F.lit(HISTORY_TITLE).alias("title"),
        F.when(F.size("history") == 0, F.lit(NO_HISTORY))
        .otherwise(F.concat(F.lit("来源 alert；"), F.array_join(lines, "；"), F.lit("。")))
        .alias("content"),
        (F.size("history") > 0).alias("sufficient"),
    )
    counted = window_counts(windows, buckets)
    suffix = F.concat(F.lit("（"), F.col("window_type"), F.lit("）"))
    tail = F.concat(F.lit(":"), F.col("canonical_key"), F.lit(":"), F.col("window_type"))
    series = F.array_join(
        F.transform(
            "series",
            lambda d: F.concat(
                F.lit("bucketStart="), _stamp(d["bucket_start"]),
                F.lit("，feedbackCount="), d["feedback_count"].cast("string"),
            ),
        ),
        "；",
    )
    has_series = F.size("series") > 0
    trend = counted.select(
        "ws",
        "alert_id",
        F.lit("ISSUE_TREND").alias("source_type"),
        F.concat(F.lit("trend"), tail).alias("reference"),
        F.concat(F.lit(TREND_TITLE), suffix).alias("title"),
        F.concat(
            _describe(), F.lit("；来源 issue_metric_bucket（日粒度）；"),
            F.when(has_series, F.concat(series, F.lit("。"))).otherwise(F.lit(NO_TREND)),
        ).alias("content"),
        has_series.alias("sufficient"),
    )
    period = period_columns(F.col("current_count"), F.col("previous_count"))
    comparison = counted.select(
        "ws",
        "alert_id",
        F.lit("PERIOD_COMPARISON").alias("source_type"),
        F.concat(F.lit("comparison"), tail).alias("reference"),
        F.concat(F.lit(COMPARISON_TITLE), suffix).alias("title"),
        F.when(~period["sufficient"], F.concat(_describe(), F.lit("；"), F.lit(NO_COMPARISON)))
        .otherwise(
            F.concat(
                _describe(),
                F.lit("；来源 issue_metric_bucket；currentCount="),
                F.col("current_count").cast("string"),
                F.lit("，previousCount="), F.col("previous_count").cast("string"),
                F.lit("，absoluteDelta="), F.format_string("%+d", period["delta"]),
                F.when(
                    period["new_activity"],
                    F.lit("，percentageChange=unavailable，newActivity=true。"),
                ).otherwise(
                    F.concat(
                        F.lit("，percentageChange="),
                        F.format_string("%+.1f%%", period["pct"]),
                        F.lit("，newActivity=false。"),
                    )
                ),
            )
        )
        .alias("content"),
        period["sufficient"].alias("sufficient"),
    )
    keys = ["ws", "canonical_key", "alert_id", "window_type"]
    has_text = F.size(F.coalesce("texts", F.array().cast("array<string>"))) > 0
    sampled = windows.join(samples, keys, "left").select(
        "ws",
        "alert_id",
        F.lit("SAMPLE_FEEDBACK").alias("source_type"),
        F.concat(F.lit("samples"), tail).alias("reference"),
        F.concat(F.lit(SAMPLE_TITLE), suffix).alias("title"),
        F.concat(
            _describe(), F.lit("；"),
            F.when(has_text, F.concat(F.lit("来源 feedback_event；样本："), F.array_join("texts", "；")))
            .otherwise(F.lit(NO_SAMPLE)),
        ).alias("content"),
        has_text.alias("sufficient"),
    )
    rows = snapshot
    for part in (earlier, trend, comparison, sampled):
        rows = rows.unionByName(part)
    return rows.withColumns(
        {"title": cap_text(F.col("title"), TITLE_CAP), "content": cap_text(F.col("content"), CONTENT_CAP)}
    ).select(*columns)


def investigation_summary(counted: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per alert: topics, windows, changes with direction, missing items, number of evidence rows.

    Computed from `window_counts` columns instead of reading figures back out of prose.
    """
    delta = F.col("current_count") - F.col("previous_count")
    change = F.concat(
        F.col("canonical_key"), F.lit(" "),
        F.when(delta > 0, F.format_string("上升+%d条", delta))
        .when(delta < 0, F.format_string("下降%d条", delta))
        .otherwise(F.lit("持平0条")),
        F.lit("（["), F.col("window_type"), F.lit("]）"),
    )
    known = (F.col("current_count") > 0) | (F.col("previous_count") > 0)
    changes = counted.groupBy("ws", "alert_id").agg(
        F.array_join(F.array_sort(F.collect_set("canonical_key")), "、").alias("topics"),
        F.array_join(F.array_sort(F.collect_set("window_type")), "、").alias("time_window"),
        F.array_join(F.array_sort(F.collect_list(F.when(known, change))), "；").alias("key_changes"),
    )
    totals = evidence.groupBy("ws", "alert_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("sufficient"), F.col("title")))), "、").alias(
            "missing"
        ),
        F.count(F.lit(1)).alias("evidence_count"),
    )
    return changes.join(totals, ["ws", "alert_id"]).select(
        "ws",
        "alert_id",
        "topics",
        "time_window",
        "key_changes",
        F.when(F.col("missing") == "", F.lit("无")).otherwise(F.col("missing")).alias("insufficient"),
        "evidence_count",
    )


def expression_of(question: Column, rules: list[Rule] = EXPRESSION_RULES) -> Column:
    """Expression a question asks about: by key, by name or name part, by pattern."""
    return bind(F.lower(F.coalesce(question, F.lit(""))), lambda t: _expression_in(t, rules))


def _expression_in(text: Column, rules: list[Rule]) -> Column:
    result = F.lit(None).cast("string")
    # Weakest evidence first; every later layer overrides it.
    # Among equals the first listed rule wins, so it comes last.
    for rule in sorted(reversed(rules), key=lambda r: r.priority):
        hit = F.lit(False)
        for pattern in rule.any_patterns:
            hit = hit | text.contains(pattern.lower())
        result = F.when(hit, F.lit(rule.canonical_key)).otherwise(result)
    result = F.when(
        text.contains(fixed.OTHER_EXPRESSION_NAME), F.lit(fixed.OTHER_EXPRESSION)
    ).otherwise(result)
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        hit = text.contains(rule.name.lower())
        for part in rule.name.split("/"):
            if part.strip():
                hit = hit | text.contains(part.strip().lower())
        result = F.when(hit, F.lit(rule.canonical_key)).otherwise(result)
    result = F.when(
        text.contains(fixed.OTHER_EXPRESSION), F.lit(fixed.OTHER_EXPRESSION)
    ).otherwise(result)
    for rule in reversed(rules):
        result = F.when(text.contains(rule.canonical_key), F.lit(rule.canonical_key)).otherwise(result)
    return result


def question_topic_match(
    questions: DataFrame,
    topics: list[tuple[str, str]],
    expressions: list[Rule] = EXPRESSION_RULES,
) -> DataFrame:
    """Topic whose key or name a question contains; the longest name wins, then the earlier entry.

    `topics` is a pack's (key, name) list, folded into the projection.
    """

    def topic_in(text: Column) -> Column:
        key = F.lit(None).cast("string")
        for topic_key, name in sorted(reversed(topics), key=lambda t: len(t[1])):
            hit = text.contains(name.lower()) | text.contains(topic_key.lower())
            key = F.when(hit, F.lit(topic_key)).otherwise(key)
        return key

    return questions.select(
        "question_id",
        bind(F.lower(F.coalesce("text", F.lit(""))), topic_in).alias("canonical_key"),
        expression_of(F.col("text"), expressions).alias("expression"),
    )


# --- evidence of a question ----------------------------------------------------------------


def iso_stamp(c: Column) -> Column:
    """ISO time in UTC; seconds and fractions only where there are any."""
    micros = F.unix_micros(c) % 60_000_000
    return F.concat(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm"),
        F.when(micros == 0, F.lit(""))
        .when(micros % 1_000_000 == 0, F.date_format(c, ":ss"))
        .when(micros % 1_000 == 0, F.date_format(c, ":ss.SSS"))
        .otherwise(F.date_format(c, ":ss.SSSSSS")),
        F.lit("Z"),
    )


def _counted(name: str, n: str) -> Column:
    return F.concat(F.col(name), F.lit(" "), F.col(n).cast("string"), F.lit(" 条"))


def _lines(rows: DataFrame, keys: list[str], line: Column, order: str = "rank") -> DataFrame:
    """One text per key from a handful of lines in order."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_n"), line.alias("line")))).alias("_l"))
    return listed.select(*keys, F.array_join(F.transform("_l", lambda x: x["line"]), "；").alias("_text"))


def _fact(rows: DataFrame, tool: str, content: list, topic: str | None = None, expression: str | None = None) -> DataFrame:
    return rows.select(
        F.lit(tool).alias("tool"),
        "ws",
        F.col(topic).alias("_topic") if topic else F.lit("").alias("_topic"),
        F.col(expression).alias("_expression") if expression else F.lit("").alias("_expression"),
        F.concat(*[F.lit(c) if isinstance(c, str) else c for c in content]).alias("content"),
    )


def _named(key: Column, rules: list[Rule]) -> Column:
    name = F.lit(fixed.OTHER_EXPRESSION_NAME)
    for rule in reversed(rules):
        name = F.when(key == rule.canonical_key, F.lit(rule.name)).otherwise(name)
    return name


def evidence_facts(
    catalog: DataFrame,
    buckets: DataFrame,
    alerts: DataFrame,
    cell_issues: DataFrame,
    events: DataFrame,
    annotations: DataFrame,
    links: DataFrame,
    window: DataFrame,
    as_of: Column,
    expressions: list[Rule] = EXPRESSION_RULES,
) -> DataFrame:
    """What each tool can say, once per workspace, topic, expression or pair of both, as one table.

    Every text holds at most five lines, so the table grows with topics and not with events or
    questions. Blank topic keys are left out: a blank marks the whole workspace here.
    """
    key = ["ws", "canonical_key"]
    names = catalog.filter("canonical_key <> ''").select(*key, "canonical_name")
    at, n = F.col("bucket_start"), F.col("feedback_count")
    week = as_of - _days(7)
    total = lambda inside: F.coalesce(F.sum(F.when(inside, n)), F.lit(0))
    sums = (
        buckets.filter((at >= as_of - _days(14)) & (at < as_of))
        .groupBy(*key)
        .agg(total(at >= week).alias("current"), total(at < week).alias("previous"))
    )
    topics = names.join(sums, key, "left").fillna(0, ["current", "previous"])
    both = [F.lit(" 最近7天 "), F.col("current").cast("string"), F.lit(" 条，前7天 "), F.col("previous").cast("string"), F.lit(" 条")]
    change = F.format_string("%+d", F.col("current") - F.col("previous"))
    compared = [*both, "，绝对变化 ", change, " 条。"]
    some = (F.col("current") != 0) | (F.col("previous") != 0)
    whole = sums.groupBy("ws").agg(F.sum("current").alias("current"), F.sum("previous").alias("previous"))

    top = ranked(topics.filter("current > 0"), EVIDENCE_TOP, [F.desc("current"), "canonical_key"])
    shown = expression_distribution(annotations, window, [*[r.canonical_key for r in expressions], fixed.OTHER_EXPRESSION])
    shown = shown.filter("feedback_count > 0").withColumn("_name", _named(F.col("expression"), expressions))
    span = window.select("ws", F.concat(iso_stamp(F.col("window_start")), F.lit(" 至 "), iso_stamp(F.col("window_end"))).alias("_span"))
    said = _lines(shown, ["ws"], _counted("_name", "feedback_count"), "label_pos").join(span, "ws")

    cross = expression_topics(annotations, links, window).join(names, key)
    best = ranked(cross, EVIDENCE_TOP, [F.desc("feedback_count"), "canonical_key"], ["ws", "expression"])
    drilled = _lines(best, ["ws", "expression"], _counted("canonical_name", "feedback_count")).join(span, "ws")
    texts = events.filter(F.trim(F.coalesce("sanitized_text", F.lit(""))) != "").select(
        "ws", "event_id", cap_text(F.col("sanitized_text"), EVIDENCE_TEXT_CAP).alias("_line")
    )
    pairs = expression_topic_samples(annotations, links, window, EVIDENCE_TOP).join(texts, ["ws", "event_id"])
    crossed = _lines(pairs, ["ws", "expression", "canonical_key"], F.col("_line")).join(names, key)

    known = alerts.join(names, key, "left").withColumn("canonical_name", F.coalesce("canonical_name", F.lit(UNKNOWN_TOPIC)))
    line = F.format_string("%s 当前值 %d、EWMA %.1f、z-score %.1f、状态 %s", "canonical_name", "current_count", "ewma", "z_score", "status")
    newest = [F.desc("created_at"), F.desc("alert_id")]
    of_topic = _lines(ranked(known, EVIDENCE_TOP, newest, key), key, line)
    recent = _lines(ranked(known, EVIDENCE_TOP, newest), ["ws"], line)

    listed = cell_issues.select(*key, "cell_no", F.posexplode_outer("sample_event_ids").alias("_pos", "event_id"))
    first = listed.groupBy(*key, "event_id").agg(F.min(F.struct("cell_no", "_pos")).alias("_at"))
    taken = ranked(first.filter("event_id is not null"), EVIDENCE_TOP, ["_at"], key).join(texts, ["ws", "event_id"])
    sampled = _lines(taken, key, F.col("_line")).join(names, key, "left_semi")

    facts = [
        _fact(topics, "ISSUE_TREND", ["来源 issue_metric_bucket；", F.col("canonical_name"), *both, "。"], "canonical_key"),
        _fact(_lines(top, ["ws"], _counted("canonical_name", "current")), "TOPIC_DISTRIBUTION", ["来源 issue_metric_bucket；最近7天 Top5：", F.col("_text"), "。"]),
        _fact(said, "EXPRESSION_DISTRIBUTION", ["来源 feedback_projection_annotation；分析窗口 ", F.col("_span"), "；L2 表达分布：", F.col("_text"), "。"]),
        _fact(
            drilled, "EXPRESSION_TOPIC_DRILLDOWN",
            ["来源 annotation ⋈ issue_link；", _named(F.col("expression"), expressions), "（", F.col("expression"), "）下 Top5 议题；分析窗口 ", F.col("_span"), "：", F.col("_text"), "。"],
            expression="expression",
        ),
        _fact(
            crossed, "EXPRESSION_TOPIC_SAMPLES",
            ["来源 feedback_event；", _named(F.col("expression"), expressions), " × ", F.col("canonical_name"), " 样本：", F.col("_text")],
            "canonical_key", "expression",
        ),
        _fact(of_topic.join(names, key, "left_semi"), "ALERT_HISTORY", ["来源 alert；", F.col("_text"), "。"], "canonical_key"),
        _fact(recent, "ALERT_HISTORY", ["来源 alert；", F.col("_text"), "。"]),
        _fact(sampled, "SAMPLE_FEEDBACK", ["来源 feedback_event；样本：", F.col("_text")], "canonical_key"),
        _fact(topics.filter(some), "PERIOD_COMPARISON", ["来源 issue_metric_bucket；", F.col("canonical_name"), *compared], "canonical_key"),
        _fact(whole.filter(some), "PERIOD_COMPARISON", ["来源 issue_metric_bucket；", WHOLE_WORKSPACE, *compared]),
    ]
    result = facts[0]
    for part in facts[1:]:
        result = result.unionByName(part)
    return result


def question_evidence(
    asked: DataFrame, tools: DataFrame, catalog: DataFrame, facts: DataFrame, expressions: list[Rule] = EXPRESSION_RULES
) -> DataFrame:
    """One evidence row per question and tool; what cannot be said is a row that says why.

    `asked(question_id, ws, canonical_key, expression)` carries the topic and expression a question
    names, `tools(question_id, tool_pos, tool)` its plan, `facts` come from `evidence_facts`. A topic
    that the workspace's catalog does not have counts as not named.
    """
    names = catalog.filter("canonical_key <> ''").select("ws", "canonical_key", "canonical_name")
    rows = asked.join(names, ["ws", "canonical_key"], "left").join(tools, "question_id")
    topic, expression, tool = (F.col(c) for c in ("_t", "_e", "tool"))
    rows = rows.select(
        "question_id", "ws", "tool_pos", "tool", "canonical_name",
        F.when(F.col("canonical_name").isNotNull(), F.col("canonical_key")).otherwise(F.lit("")).alias("_t"),
        F.coalesce("expression", F.lit("")).alias("_e"),
    )
    by_topic = tool.isin("ISSUE_TREND", "ALERT_HISTORY", "SAMPLE_FEEDBACK", "PERIOD_COMPARISON", "EXPRESSION_TOPIC_SAMPLES")
    by_expression = tool.isin("EXPRESSION_TOPIC_DRILLDOWN", "EXPRESSION_TOPIC_SAMPLES")
    wanted = rows.withColumns(
        {
            "_topic": F.when(by_topic, topic).otherwise(F.lit("")),
            "_expression": F.when(by_expression, expression).otherwise(F.lit("")),
        }
    )
    found = wanted.join(facts, ["tool", "ws", "_topic", "_expression"], "left")
    has = F.col("content").isNotNull()
    no_topic, no_expression = topic == "", expression == ""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = F.coalesce("canonical_name", F.lit(WHOLE_WORKSPACE))
    label = _named(expression, expressions)
    scope = F.when(no_topic, F.lit("workspace")).otherwise(topic)
    references = {
        "ISSUE_TREND": F.when(has, text("trend:", topic, ":last_14_days")).otherwise(F.lit("trend:unresolved")),
        "TOPIC_DISTRIBUTION": F.lit("distribution:last_7_days"),
        "EXPRESSION_DISTRIBUTION": F.lit("expression:distribution"),
        "EXPRESSION_TOPIC_DRILLDOWN": F.when(no_expression, F.lit("expression:topics:unresolved")).otherwise(text("expression:topics:", expression)),
        "EXPRESSION_TOPIC_SAMPLES": F.when(no_expression, F.lit("expression:samples:unresolved"))
        .when(no_topic, F.lit("expression:samples:topic_unresolved"))
        .otherwise(text("expression:samples:", expression, ":", topic)),
        "ALERT_HISTORY": F.when(has & ~no_topic, text("alerts:", topic)).otherwise(F.lit("alerts:recent")),
        "SAMPLE_FEEDBACK": F.when(no_topic, F.lit("samples:unresolved")).otherwise(text("samples:", topic)),
        "PERIOD_COMPARISON": F.when(has, text("comparison:", scope, ":last_14_days")).otherwise(F.lit("comparison:last_14_days")),
        "DATA_AVAILABILITY": F.lit("availability:version_event"),
    }
    gaps = {
        "ISSUE_TREND": F.lit(TREND_NEEDS_TOPIC),
        "TOPIC_DISTRIBUTION": F.lit(NO_TOPICS),
        "EXPRESSION_DISTRIBUTION": F.lit(NO_EXPRESSIONS),
        "EXPRESSION_TOPIC_DRILLDOWN": F.when(no_expression, F.lit(DRILLDOWN_NEEDS_EXPRESSION)).otherwise(text(label, NO_DRILLDOWN)),
        "EXPRESSION_TOPIC_SAMPLES": F.when(no_expression, F.lit(CROSS_NEEDS_EXPRESSION))
        .when(no_topic, F.lit(CROSS_NEEDS_TOPIC))
        .otherwise(text(label, " × ", name, NO_CROSS_SAMPLES)),
        "ALERT_HISTORY": F.lit(NO_ALERTS),
        "SAMPLE_FEEDBACK": F.when(no_topic, F.lit(SAMPLES_NEED_TOPIC)).otherwise(F.lit(NO_TOPIC_SAMPLES)),
        "PERIOD_COMPARISON": text(name, NO_PERIODS),
        "DATA_AVAILABILITY": F.lit(NO_VERSION_DATA),
    }

    def chosen(values: dict[str, Column]) -> Column:
        result = F.lit(None).cast("string")
        for tool_name, value in values.items():
            result = F.when(tool == tool_name, value).otherwise(result)
        return result

    title = chosen({t: F.lit(v) for t, v in TOOL_TITLES.items()})
    return found.select(
        "question_id", "tool_pos", "tool",
        chosen(references).alias("reference"),
        F.when((tool == "ALERT_HISTORY") & ~has, F.lit(NO_ALERT_TITLE)).otherwise(title).alias("title"),
        F.coalesce("content", chosen(gaps)).alias("content"),
        has.alias("sufficient"),
    )
