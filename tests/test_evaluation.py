import pytest
from pyspark.sql import functions as F

from tallyvox.operators import conversations as cv
from tallyvox.operators import evaluation as ev


def test_case_scores(spark):
    cases = spark.createDataFrame([("c1", "CROSS_DOCUMENT", False), ("c2", "REFUSAL", True)], "case_key string, question_type string, should_refuse boolean")
    evidence = spark.createDataFrame([("c1", 0, "CHUNK", 1, 1, 11, "a"), ("c1", 1, "DOCUMENT", 2, None, None, "b"), ("c1", 2, "DOCUMENT", 3, None, None, "b")],
        "case_key string, sort_order int, granularity string, document_id long, version_no long, chunk_id long, requirement_key string")
    ranked = spark.createDataFrame([("c1", 1, 9, 1, 90), ("c1", 2, 1, 1, 11), ("c1", 9, 3, 1, 30)], "case_key string, rank int, document_id long, version_no long, chunk_id long")
    r = {x.case_key: x for x in ev.retrieval_case_scores(cases, evidence, ranked).collect()}["c1"]
    assert (r.document_hit_at1, r.document_hit_at3, r.chunk_hit_at3) == (False, True, True)
    assert r.reciprocal_rank == 0.5 and not r.group_coverage_at8 and not r.primary_hit_at8
    groups = {x.group_key: (x.first_rank, x.satisfied) for x in ev.requirement_groups(evidence, ranked).collect()}
    assert groups == {"a": (2, True), "b": (9, False)}


def test_gate(spark):
    names = ["document_recall_at8", "chunk_recall_at8", "evidence_coverage_at8", "fact_coverage", "forbidden_rate", "refusal_compliance", "false_abstention", "citation_support"]
    schema = "dataset_key string, checksum string, failed_cases long, " + ", ".join(n + " double" for n in names)
    base = spark.createDataFrame([("d", "x", 0, *[0.5] * 8)], schema)
    same = ev.regression_gate(base, base).first()
    assert same.passed and same.violations == []
    worse = ev.regression_gate(base, base.withColumns({"chunk_recall_at8": F.lit(0.47), "forbidden_rate": F.lit(0.52), "failed_cases": F.lit(1)})).first()
    assert worse.violations == ["chunk_recall_at8_regressed", "forbidden_claim_rate_regressed", "failed_case_count_increased"]
    other = ev.regression_gate(base, base.withColumn("checksum", F.lit("y"))).first()
    assert other.violations == ["dataset_checksum_mismatch"]


def test_errors_stop_the_job(spark):
    run = spark.createDataFrame([("c", "fact", "succeeded", 1, 0, True, True)] * 2, "case_id string, category string, status string, covered_facts int, hit_forbidden int, refusal_compliant boolean, specific boolean")
    with pytest.raises(Exception):
        ev.case_delta(run, run).collect()
    with pytest.raises(ValueError):
        ev.case_slice(spark.createDataFrame([("a",)], "case_key string"), spark.createDataFrame([("# a",)], "value string"))


def test_conversations(spark):
    msgs = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(14)], "session_id long, seq long, role string, content string")
    assert cv.rolling_summary(msgs).first().summary == "user: m0；assistant: m1"
    saved = spark.createDataFrame([(1, "user: m0")], "session_id long, summary string")
    assert cv.extend_summary(saved, msgs.filter("seq = 1")).first().summary == "user: m0；assistant: m1"
    last = spark.createDataFrame([(1, 0, "user", "玩家问 v1.4.2 登录异常的说明？")], "session_id long, seq long, role string, content string")
    focus = cv.focus_extract(last)
    r = focus.first()
    assert (r.topic, r.version) == ("登录异常", "1.4.2")
    asked = spark.createDataFrame([(1, 1, "它什么时候好"), (2, 1, "为什么"), (3, 1, "登录呢"), (4, 2, "它呢")], "question_id long, session_id long, text string")
    got = {x.question_id: (x.rewritten, x.reason) for x in cv.follow_up_rewrite(asked, focus).collect()}
    assert got[1] == ("1.4.2 登录异常什么时候好", "contextual_reference")
    assert got[2] == ("1.4.2 登录异常 为什么", "contextual_reference")
    assert got[3][1] == "self_contained" and got[4][1] == "focus_empty"


def test_checksum_of_streamed_lines(spark):
    import hashlib

    from tallyvox.operators import evaluation as ev

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        data = spark.createDataFrame([("d1", "v", "s", "c"), ("d2", None, "s", "c"), ("d0", "v", "s", "c")], "dataset_key string, dataset_version string, split string, corpus_version string")
        case = [(d, f"{d}-{k:03d}", f"question {k}", "T", "E", k % 2 == 0) for d in ("d1", "d2", "gone") for k in range(40)]
        cases = spark.createDataFrame(case, "dataset_key string, case_key string, question_text string, question_type string, difficulty string, should_refuse boolean").repartition(5)
        proof = [(c[1], n, "CHUNK", n, 1, None, None if n else "g") for c in case for n in range(11)]
        evidence = spark.createDataFrame(proof, "case_key string, sort_order int, granularity string, document_id long, version_no int, chunk_id long, requirement_key string").repartition(5)
        claim = [(c[1], n, "REQUIRED_FACT", f"fact {n}", 2) for c in case[::2] for n in range(3)]
        claims = spark.createDataFrame(claim, "case_key string, sort_order int, assertion_type string, assertion_text string, weight int").repartition(5)
        got = {r.dataset_key: r.checksum for r in ev.dataset_checksum(data, cases, evidence, claims).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key, version in (("d1", "v"), ("d2", "null"), ("d0", "v")):
        text = f"{key}|{version}|s|c\n"
        text += "".join(f"case:{c[1]}|{c[2]}|T|E|{str(c[5]).lower()}\n" for c in case if c[0] == key)
        text += "".join(f"evidence:{p[0]}|CHUNK|{p[3]}|1|null|{p[6] or ''}\n" for p in proof if p[0].startswith(key))
        text += "".join(f"assertion:{a[0]}|REQUIRED_FACT|{a[3]}|2\n" for a in claim if a[0].startswith(key))
        want[key] = hashlib.sha256(text.encode()).hexdigest()
    assert got == want
