from pyspark.sql import functions as F

from tallyvox.functions.text import analysis_normalize
from tallyvox.operators import classify as cl
from tallyvox.plans.projection import project
from tallyvox.sources import fixed_rules as fixed
from tallyvox.sources.rule_tables import Rule


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "event_id long, normalized_text string")


def test_tie_is_ambiguous(spark):
    rules = [Rule("a", "A", 50, ["登录"]), Rule("b", "B", 50, ["到账"])]
    rows = cl.topic_classify(frame(spark, ["登录 到账"]), rules).orderBy("rank").collect()
    assert [(r.canonical_key, r.method, r.confidence) for r in rows] == [("a", "rule", 1.0), ("b", "ambiguous", 0.5)]
    assert cl.review_reason(frame(spark, ["登录 到账"]), rules).first().reason == "ambiguous_topics"


def test_three_rules(spark):
    rules = [Rule("a", "A", 3, ["甲"]), Rule("b", "B", 2, ["乙"]), Rule("c", "C", 1, ["丙"])]
    assert cl.topic_classify(frame(spark, ["甲乙丙"]), rules).count() == 2
    assert cl.review_reason(frame(spark, ["甲乙丙"]), rules).first().reason == "too_many_topics"


def test_order_of_equal_priority(spark):
    rules = [Rule("h1l1", "", 2, ["x"]), Rule("h1l5", "", 2, ["abcde"]), Rule("h4l2", "", 2, ["ab", "bc", "cd", "de"]), Rule("p1", "", 1, ["x"])]
    found = frame(spark, ["abcde x"]).select(cl.candidates(F.col("normalized_text"), rules).alias("c")).first().c
    assert [c.canonical_key for c in found] == ["h1l5", "h1l1", "h4l2", "p1"]
    found = frame(spark, ["abcde x"]).select(cl.candidates(F.col("normalized_text"), rules, "desc").alias("c")).first().c
    assert found[0].canonical_key == "h4l2"


def test_default_pack_slang(spark):
    texts = ["就是挂太多", "画质很差，完全简圈钱", "怎么老是开始的时候配不到队友呢"]
    rows = frame(spark, texts).withColumn("normalized_text", analysis_normalize(F.col("normalized_text"), fixed.SYNONYMS))
    got = {}
    for r in cl.topic_classify(rows).collect():
        got.setdefault(r.event_id, set()).add(r.canonical_key)
    assert "topic_social" in got[0] and "topic_visual" in got[1] and "topic_matchmaking" in got[2]


def test_sentiment_per_topic(spark):
    events = frame(spark, ["画面很好但是网络卡顿严重，经常掉线"])
    labels = spark.createDataFrame([(0, "graphics"), (0, "network"), (0, "topic_x")], "event_id long, canonical_key string")
    got = {r.canonical_key: r.sentiment for r in cl.topic_sentiment(events, labels).collect()}
    assert got == {"graphics": "positive", "network": "negative", "topic_x": "mixed"}


def test_expression_defaults(spark):
    rows = cl.expression_classify(frame(spark, ["", "希望优化", "太烂了 建议"])).orderBy("event_id").collect()
    assert [r.expression for r in rows] == ["expr_other", "expr_suggestion", "expr_suggestion"]


def test_one_pass_equals_joins(spark):
    texts = ["网络卡顿 登录失败", "画面 建模 好", "无关内容", "充值 到账 差", ""]
    events = frame(spark, texts)
    labels = cl.general_fallback(events, cl.topic_classify(events))
    joined = cl.issue_links(labels, cl.topic_sentiment(events, labels))
    columns = ["event_id", "canonical_key", "rank", "method", "confidence", "sentiment"]
    classified = cl.classify_events(events)
    single = cl.classified_links(classified)
    assert sorted(map(tuple, joined.select(*columns).collect())) == sorted(map(tuple, single.select(*columns).collect()))
    by_join = cl.review_candidates(joined, cl.review_reason(events))
    by_row = cl.classified_reviews(classified)
    cols = ["event_id", "reason_code", "suggested_key", "suggested_sentiment"]
    assert sorted(map(tuple, by_join.select(*cols).collect())) == sorted(map(tuple, by_row.select(*cols).collect()))


def test_projection(spark):
    rows = [(1, i, f"2024-01-{1 + i // 20:02d} 10:00:00", "app", "闪退 崩溃" if i % 2 else "网络 延迟 建议") for i in range(60)]
    events = spark.createDataFrame(rows, "ws long, event_id long, t string, source_kind string, normalized_text string").withColumn("occurred_at", F.col("t").cast("timestamp")).drop("t")
    out = project(events)
    assert out["annotations"].count() == 60
    assert out["issue_buckets"].agg(F.sum("feedback_count")).first()[0] == out["links"].count()
    assert out["cells"].agg(F.sum("event_count")).first()[0] == 60
    assert out["risk"].filter("risk_level IS NULL").count() == 0
