import datetime as dt

from pyspark.sql import functions as F

from tallyvox.functions import questions as qs
from tallyvox.functions import text as tx
from tallyvox.functions.registry import register_functions
from tallyvox.functions.scores import claimed_count, risk_score
from tallyvox.sources import fixed_rules as fixed


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_masks(spark):
    lit = F.lit("联系 a.b@x-y.com 或 +86 13812345678，订单 1138123456789 不变")
    assert value(spark, tx.pii_mask(lit)) == "联系 [EMAIL] 或 [PHONE]，订单 1138123456789 不变"


def test_analysis_normalize(spark):
    out = value(spark, tx.analysis_normalize(F.lit("　ＡＢＣ！！網絡 遲、登不上。"), fixed.SYNONYMS))
    assert out == "abc 网络 迟 登录失败"


def test_times(spark):
    parse = lambda s: value(spark, tx.parse_occurred_at(F.lit(s)))
    assert parse("2024-01-02T03:04:05+08:00") == parse("2024-01-01T19:04:05Z")
    assert parse(" 2024-01-02 03:04:05 ") == parse("2024-01-02T03:04:05Z")
    assert parse("2024-01-02T03:04:05") is None
    assert parse("nonsense") is None
    assert isinstance(parse("2024-01-02 03:04:05"), dt.datetime)


def test_token_estimate(spark):
    tokens = lambda s: value(spark, tx.token_estimate(F.lit(s)))
    assert tokens("") == 1
    assert tokens("网络卡顿") == int(4 / 1.5) + 1
    assert tokens("abcdefgh" + chr(0x1F600)) == int(10 / 4.0) + 1


def test_assertions(spark):
    match = lambda a, b: value(
        spark, tx.assertion_match(tx.answer_normalize(F.lit(a)), tx.answer_normalize(F.lit(b)))
    )
    assert match("本周 A-1 正常。", "a1正常")
    assert not match("", "x")
    assert match("版本更新后登录失败增多，需要回滚处理方案", "版本更新后登录失败增多了需要回滚处理")
    assert not match("完全无关的回答", "版本更新后登录失败增多了需要回滚处理")


def test_question_texts(spark):
    assert value(spark, qs.identifiers(F.lit("see ab-1234, XY567 and AB-1234"))) == ["AB-1234", "XY-567"]
    expanded = value(spark, qs.query_expand(F.lit("v1.4.2 公告 2024年3月")))
    assert expanded == "v1.4.2 公告 2024年3月 1.4.2 v1.4.2 2024-03 3月 公告"
    assert value(spark, qs.type_route(F.lit("复盘版本"))) == ["RELEASE_NOTE", "POSTMORTEM"]
    parts = value(spark, qs.subqueries(F.lit("值班追问：外挂举报和暑期签到的流程是什么？"), F.lit("CROSS_DOCUMENT")))
    assert parts == ["值班追问：外挂举报的流程是什么", "值班追问：暑期签到的流程是什么"]
    assert value(spark, qs.force_abstain(F.lit("你好"), F.lit(None).cast("string")))
    assert not value(spark, qs.force_abstain(F.lit("登录失败怎么办"), F.lit("SINGLE_DOCUMENT_FACT")))


def test_plain_titles_have_the_same_tokens_and_anchors(spark):
    words = ["", "a", "ab", "abcd", "abcde", "straße", "é1.2", "v1.2.3", "😀😀😀😀😀", "$1", "\\", "faq", "postmortem", "sop", "abcde", "\u3000x", "ab-123"]
    titles = [sep.join(words[i:] + words[:i]) for sep in (" ", "; ", "\t?\n", "：") for i in range(len(words))] + ["", "x"]
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    title = F.col("title")
    general = qs._tokens(qs.versions(title), F.regexp_replace(title, qs.TOKEN_EDGES, " "))
    for r in rows.select("title", general.alias("want"), qs.entity_tokens(title).alias("tokens"), qs.title_anchors(title).alias("anchors")).collect():
        assert r.tokens == r.want
        assert r.anchors == [a for a in ("faq", "postmortem", "sop") if a in r.title]


def test_scores(spark):
    r = value(spark, risk_score(F.lit(8.0), F.lit(100), F.lit(20), F.lit(4)))
    assert (r["score"], r["level"]) == (89, "P0")
    r = value(spark, risk_score(F.lit(3.0), F.lit(5), F.lit(5), F.lit(0)))
    assert (r["score"], r["level"]) == (25, "P3")
    claims = ["本周 85 条工单", "工单共 85 条", "", "99999999999 条工单"]
    assert [value(spark, claimed_count(F.lit(s))) for s in claims] == [85, 0, 0, 0]


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT token_estimate('abcd') AS t, import_normalize('  A  b ') AS n, pii_mask('x@y.com') AS m").first()
    assert (row.t, row.n, row.m) == (2, "a b", "[EMAIL]")
