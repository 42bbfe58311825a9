"""Work that is done once, and rows that carry no texts."""

import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyvox.catalog import feedback as fb
from tallyvox.catalog import gold as gd
from tallyvox.catalog import inputs as src
from tallyvox.catalog import knowledge as kn
from tallyvox.catalog.base import QUERIES, SQL
from tallyvox.functions import text as tx
from tallyvox.operators import classify as cl
from tallyvox.operators import risk as rk
from tallyvox.operators import search as se
from tallyvox.operators import selection as sl

TEXTS = ["the network, est und", "der ment ado nt", "eins die heit que", "", "bad heit\x01 und\t THE"]


def tables(spark, folder):
    """The tables the queries below read, of a few rows."""
    rows = [(i, TEXTS[i % 5], "en", "web", len(TEXTS[i % 5])) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, [1.0, float(i), 2.0], i % 3) for i in range(20)], "vec_id long, embedding array<float>, label long").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(0, "the network"), (1, "ment ado")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reconcile_sends_facts_to_the_reports(spark):
    claims = spark.createDataFrame(
        [(1, 7, "本周 12 条工单 x", {"pay": 3}), (2, 7, "共 9 条", {}), (3, 7, "共 4 条工单", {"pay": 99}), (4, 8, None, {})],
        "report_id long, ws long, summary string, mentions map<string,int>",
    )
    facts = spark.createDataFrame([(7, 12, {"pay": 3}), (9, 1, {})], "ws long, total int, issue_mentions map<string,int>")
    got = rk.reconcile(claims, facts)
    assert "BroadcastHashJoin" in plan_of(got) and "SortMergeJoin" not in plan_of(got)
    assert sorted((r.report_id, r.check, r.passed, r.detail, r.override) for r in got.collect()) == [
        (1, "alert pay mentions upper bound", True, "mentions=3, actual=12", None),
        (1, "executiveSummary ticket count", True, "claimed=12, actual=12", None),
        (2, "executiveSummary ticket count", False, "claimed=0, actual=12", None),
        (3, "alert pay mentions upper bound", False, "mentions=99, actual=12", "3"),
        (3, "executiveSummary ticket count", False, "claimed=4, actual=12", None),
    ]


def test_signals_are_found_once(spark):
    asked = spark.createDataFrame([(1, "alpha v1.2 alpha gamma"), (2, "first entry和second entry"), (3, None), (4, "")], "query_id long, text string")
    rows = sl.signal_rows(sl.entity_signals(asked))
    assert not re.search(r"Filter \(+size\(", plan_of(rows))  # an inferred one would find them a second time
    generated = rows._jdf.queryExecution().optimizedPlan().toString().split("Generate inline")[1]
    assert re.match(r"\([^\n]*?\), \[1(, [2-9])*\], true", generated), generated  # all but the id ends here
    got = {(r.query_id, r.group_no): r for r in rows.collect()}
    assert sorted(got) == [(1, 0), (2, 1), (2, 2), (3, 0), (4, 0)]
    assert got[1, 0].tokens == ["1.2", "alpha", "alph", "v1.2", "gamma", "gamm"] and got[1, 0].versions == ["1.2"]


def test_entity_signals_are_all_shown(spark, tmp_path):
    texts = {5: "Alpha v1.2 alpha gamma", 11: "first FAQ entry ab-123和second 热修 v2.10 说明", 17: None, 2: "unread", 23: "a1.2 é3.4的 5.6.7，一二三四五六七八九，网络卡顿\x01 Sop"}
    rows = [(i, t, "en", "web", 1) for i, t in texts.items()] + [(5, texts[5], "en", "web", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["entity_signals"](spark, str(tmp_path))
    got = [r.asDict() for r in found.collect()]
    # Tokens, versions, identifiers and title anchors of each group.
    groups = "first,firs,faq,entry,entr,ab-123,ab-1;;AB-123;faq|2.10,second,seco,热修,v2.10,v2.1;2.10;;热修"
    names = ["question_type", "n_versions", "n_hints", "n_ids", "tokens", "versions", "ids", "hints", "groups"]
    want = {
        2: ("CHITCHAT", 0, 0, 0, "hi", "", "", "", ""),
        5: ("SINGLE_DOCUMENT_FACT", 1, 0, 0, "1.2|alpha|alph|v1.2|gamma|gamm", "1.2", "", "", ""),
        11: (None, 1, 2, 1, "first|firs|faq|entry|entr|ab-123|ab-1|2.10|second|seco|热修|v2.10|v2.1", "2.10", "AB-123", "faq|release", groups),
        17: ("SINGLE_DOCUMENT_FACT", 0, 0, 0, "", "", "", "", ""),
        23: (
            None, 1, 0, 0, "5.6.7|a1.2|é3.4的|é3.4|5.6.|一二三四五六七八九|一二三四|一二三四五六七八|一二|网络卡顿|sop|网络", "5.6.7", "", "",
            "5.6.7,a1.2,é3.4的,é3.4,5.6.;5.6.7;;|一二三四五六七八九,一二三四,一二三四五六七八,一二;;;|网络卡顿,sop,网络;;;sop",
        ),
    }
    assert len(got) == len(rows) and all(tuple(r[n] for n in names) == want[r["query_id"]] for r in got), got
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    plain = db.execute(f"SELECT {', '.join(found.columns)} FROM ({SQL['entity_signals']}) q").fetchall()
    assert sorted(map(str, plain)) == sorted(str(tuple(r.values())) for r in got)


def test_model_labels_shuffle_no_text(spark):
    events = spark.createDataFrame([(1, "x" * 20), (2, "the"), (3, "y")], "event_id long, normalized_text string")
    expressions = events.select("event_id", F.lit("expr_complaint").alias("expression"))
    scored = spark.createDataFrame([(1, "graphics", 0.9), (3, "graphics", 0.9)], "event_id long, scored_key string, scored_confidence double")
    got = cl.model_label_merge(events, cl.topic_classify(events, fb.TOPICS), expressions, scored, ["graphics"])
    assert not re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*Project \[event_id#\w+, normalized_text", plan_of(got))
    assert sorted((r.event_id, r.canonical_key, r.method, r.accepted) for r in got.collect()) == [
        (1, "graphics", "llm", True), (2, "topic_network", "rule", None), (3, "topic_general", "general", None),
    ]


def test_texts_are_normalized_once(spark, tmp_path, monkeypatch):
    folder, seen = tables(spark, tmp_path / "t"), []
    for name in ("topic_sentiment", "model_label_merge"):
        real = getattr(cl, name)
        monkeypatch.setattr(cl, name, lambda events, *more, real=real: seen.append(events) or real(events, *more))
        QUERIES[name](spark, folder).collect()
    assert len(seen) == 2 and all("/stored-" in f for events in seen for f in events.inputFiles())


def test_separators_match_the_plain_class(spark):
    plain = rf"[{tx.WHITESPACE_CLASS}\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x{{3001}}-\x{{303F}}]+"
    points = spark.range(1, 0x30000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    assert points.where(F.regexp_replace("c", plain, "") != F.regexp_replace("c", tx.SEPARATORS, "")).count() == 0


def test_assertions_make_no_list_of_vectors(spark, tmp_path, monkeypatch):
    folder = tables(spark, tmp_path / "t")
    whole = QUERIES["answer_case_scores"](spark, folder).agg(F.sum("covered_facts")).first()[0]

    def near(*_):
        raise AssertionError("the nearest vectors are not needed")

    monkeypatch.setattr(src, "near", near)
    rows = QUERIES["assertion_match"](spark, folder).collect()
    assert sum(r.holds for r in rows if r.sort_order < 2) == whole > 0


def test_gate_makes_scores_once(spark, tmp_path, monkeypatch):
    folder, seen = tables(spark, tmp_path / "t"), []
    real = gd.ev.regression_gate
    monkeypatch.setattr(gd.ev, "regression_gate", lambda base, candidate: seen.append((base, candidate)) or real(base, candidate))
    QUERIES["regression_gate"](spark, folder).collect()
    assert all("Aggregate" not in plan_of(df) and "Expand" not in plan_of(df) for df in seen[0])


def pieces(text):
    return {f"  {w} "[i : i + 3] for w in text.split(" ") if w for i in range(len(w) + 1)}


def test_trigrams_inside_tasks(spark):
    rng = np.random.default_rng(3)
    for letters in ("ab1 ", "aé建 ", "a\U00020000建 "):
        texts = [re.sub(" +", " ", "".join(rng.choice(list(letters), rng.integers(0, 30)))) for _ in range(700)] + ["", None]
        rows, codes = se.trigram_sets(pa.array(texts))
        got = [set() for _ in texts]
        for r, c in zip(rows.tolist(), codes.tolist()):
            got[r].add("".join(chr((c >> s) & 0x1FFFFF) for s in (42, 21, 0)))
        assert got == [pieces(t or "") for t in texts] and len(rows) == sum(map(len, got))


def test_products_count_what_posting_lists_count(monkeypatch):
    rng = np.random.default_rng(4)
    words = pa.array([" ".join("".join(rng.choice(list("abcd"), 4)) for _ in range(rng.integers(0, 9))) for _ in range(60)])
    vocabulary = np.unique(se.trigram_sets(words)[1])
    index, sets = se._Index(words, vocabulary), se._Sets(words, vocabulary)
    monkeypatch.setattr(se, "DENSE_CHUNKS", 7 * len(vocabulary))
    shared = {}
    for cost in (0, 1 << 40):
        monkeypatch.setattr(se, "POSTINGS_COST", cost)
        shared[cost] = index.shared(sets)
    assert (shared[0] == shared[1 << 40]).all() and shared[0].sum() > 0


def test_lexical_arm_is_made_once(spark, tmp_path, monkeypatch):
    folder, calls = tables(spark, tmp_path / "t"), []
    real = se.lexical_arm
    monkeypatch.setattr(kn.se, "lexical_arm", lambda *a, **k: calls.append(a[1]) or real(*a, **k))
    assert QUERIES["subquery_quota"](spark, folder).count() > 0
    assert len(calls) == 1 and all("/stored-" in f for f in calls[0].inputFiles())


def test_best_hits_in_one_order():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000, 20000):
        rows, ids, found = rng.integers(0, 50, n), rng.integers(0, 10**6, n), np.round(rng.integers(-30, 31, n) / 30, 9)
        got, want = se._best_first(rows, ids, found), np.lexsort((ids, -found, rows))
        assert all((c[got] == c[want]).all() for c in (rows, ids, found))
