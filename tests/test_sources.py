import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyvox.operators import ingest as ig
from tallyvox.sources import feedback_csv as fc
from tallyvox.sources import rule_tables as rt
from tallyvox.sources import sinks

MAPPING = fc.ImportMapping("用户反馈", "提交时间", "来源", "工单号", {"version": "版本号"})


def test_csv_to_events(spark, tmp_path):
    text = chr(0xFEFF) + '用户反馈,提交时间,来源,工单号,版本号\n"登录 ""失败"", 联系 a@b.com\n第二行", 2024-01-02T03:04:05Z ,App, T1 ,1.0\n 13812345678,2024-01-02 03:04:05,App,T1,\nx,bad,App,T2,\n'
    (tmp_path / "f.csv").write_text(text, encoding="utf-8")
    raw = fc.read_feedback_csv(spark, str(tmp_path))
    events = ig.to_events(fc.apply_mapping(raw, MAPPING)).withColumns({"ws": F.lit(1), "source_id": F.lit(1)})
    none = events.select(*ig.EVENT_KEY).limit(0)
    rows = ig.dedupe_insert(events, none).orderBy("_seq").collect()
    assert [r.outcome for r in rows] == ["imported", "duplicate", "failed"]
    assert rows[0].sanitized_text == '登录 "失败", 联系 [EMAIL]\n第二行' and rows[0].dimensions == {"version": "1.0"}
    assert rows[1].sanitized_text == "[PHONE]" and rows[1].dimensions == {}
    report = ig.import_report(ig.dedupe_insert(events, none).withColumn("row_no", F.col("_seq") + 1)).first()
    assert (report.imported, report.duplicates, report.failed) == (1, 1, 1)
    assert report.errors[0].startswith("第 4 行：occurred_at")
    assert fc.file_manifest(spark, str(tmp_path)).first().valid


def test_header_and_mapping_checks(spark):
    with pytest.raises(fc.InvalidHeader):
        fc.validate_headers(["a", "a"])
    with pytest.raises(fc.InvalidHeader):
        fc.validate_headers(["a", " "])
    bad = fc.ImportMapping("a", "a", "", "zz", {"Bad Key": "a"})
    fields = {r.field for r in fc.validate_mapping(spark, bad, ["a", "b"]).collect()}
    assert fields == {"occurred_at", "source", "external_ref", "mapping", "dimensions.Bad Key"}
    assert fc.mapping_violations(MAPPING, ["用户反馈", "提交时间", "来源", "工单号", "版本号"]) == []


def test_rule_tables(spark, tmp_path):
    def put(kind, pack, rows):
        folder = tmp_path / kind / pack
        folder.mkdir(parents=True)
        (folder / "part.json").write_text("\n".join(json.dumps(r) for r in rows))

    put("rules", "p", [{"pack_id": "p", "canonical_key": "k", "name": "n", "priority": 1, "rule_pos": 0, "any_patterns": ["x"], "all_patterns": [], "exclude_patterns": []}])
    put("rules", "_draft", [{"pack_id": "d", "canonical_key": "k"}])
    put("topics", "p", [{"pack_id": "p", "canonical_key": k, "name": k, "alert_eligible": True, "sort_order": n} for n, k in ((2, "topic_general"), (1, "k"))])
    put("synonyms", "all", [{"synonym_pos": 0, "variants": ["a"], "target": "b"}])
    rules, topics, _ = rt.load_rules(spark, str(tmp_path))
    assert [r.canonical_key for r in topics.collect()] == ["k", "topic_general"]
    assert rt.rule_list(rules.filter("pack_id = 'p'"))[0].any_patterns == ["x"]
    put("topics", "q", [{"pack_id": "q", "canonical_key": "k", "name": "k", "alert_eligible": True, "sort_order": 1}])
    with pytest.raises(ValueError):
        rt.load_rules(spark, str(tmp_path))


def facts(spark, path, *rows):
    return {"a": spark.createDataFrame([r for r in rows if r[1] != "t"], "ws long, k string"), "b": spark.createDataFrame([r for r in rows if r[1] == "t"], "ws long, k string")}


def listed(spark, path, table, version=None):
    return sorted((r.ws, r.k) for r in sinks.read_facts(spark, path, table, version).collect())


def workspaces(spark, *ids):
    return spark.createDataFrame([(w,) for w in ids], "ws long")


def test_overwrite_keeps_other_workspaces(spark, tmp_path):
    path = str(tmp_path)
    sinks.commit_facts(spark, path, facts(spark, path, (1, "a"), (2, "b"), (1, "t")), workspaces(spark, 1, 2))
    sinks.commit_facts(spark, path, facts(spark, path, (1, "c")), workspaces(spark, 1))
    assert listed(spark, path, "a") == [(1, "c"), (2, "b")] and listed(spark, path, "b") == []
    # A projection that gives nothing removes what was there, in all tables.
    sinks.commit_facts(spark, path, facts(spark, path), workspaces(spark, 1))
    assert listed(spark, path, "a") == [(2, "b")]


def test_failed_commit_leaves_the_old_facts(spark, tmp_path):
    path = str(tmp_path)
    sinks.commit_facts(spark, path, facts(spark, path, (1, "a"), (1, "t")), workspaces(spark, 1))
    broken = facts(spark, path, (1, "new"), (1, "t"))
    broken["b"] = broken["b"].withColumn("k", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        sinks.commit_facts(spark, path, broken, workspaces(spark, 1))
    with pytest.raises(Exception, match="not part of the commit"):
        sinks.commit_facts(spark, path, facts(spark, path, (9, "x")), workspaces(spark, 1))
    assert listed(spark, path, "a") == [(1, "a")] and listed(spark, path, "b") == [(1, "t")]


def test_commits_are_merged(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    want = {}
    for k in range(18):
        ws = k % 5
        sinks.commit_facts(spark, path, facts(spark, path, *([(ws, f"v{k}")] if k % 3 else [])), workspaces(spark, ws))
        want[ws] = [(ws, f"v{k}")] if k % 3 else []
    assert listed(spark, path, "a") == sorted(r for rows in want.values() for r in rows)
    assert len(sinks.RunLog(spark, path).version()["runs"]) < 8


def test_headers_of_one_order_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,y\n3,4\n")
    assert sorted((r.x, r.y) for r in fc.read_feedback_csv(spark, str(tmp_path)).collect()) == [("1", "2"), ("3", "4")]
    (tmp_path / "b.csv").write_text("y,x\n2,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        fc.read_feedback_csv(spark, str(tmp_path)).collect()


def test_record_numbers_over_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,t\n" + "".join(f"{k},{'x' * 200}\n" for k in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = fc.read_feedback_csv(spark, str(tmp_path), multi_line=False)
        assert rows.rdd.getNumPartitions() > 2
        assert all(int(r.n) + 1 == r.row_no for r in fc.record_numbers(rows).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_large_topic_list(spark):
    from tallyvox.operators.dashboard import topic_catalog_fill

    topics = spark.createDataFrame([(f"t{k}", k, "n", True) for k in range(5000)], "canonical_key string, sort_order int, name string, alert_eligible boolean")
    filled = topic_catalog_fill(spark.createDataFrame([(1,), (2,)], "ws long"), topics, spark.createDataFrame([(1, "t7", 3)], "ws long, canonical_key string, feedback_count long"))
    assert filled.count() == 10_000 and filled.where("feedback_count = 3").count() == 1


def one_task(spark, path):
    """The same file as one task's CSV reader sees it."""
    import csv

    names = next(csv.reader(open(path, encoding="utf-8", newline="")))
    read = spark.read.schema(", ".join(f"`{n}` string" for n in [*names, fc.CORRUPT])).options(**fc.CELLS)
    return [tuple(r) for r in read.option("header", "true").option("multiLine", "true").csv(str(path)).collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [64, 300, 4096])
def test_records_with_line_breaks_over_splits(spark, tmp_path, end, split):
    rng = random.Random(split)
    cells = ["plain", "", " blank around ", '"a, b"', '"line{0}break"', '"{0}{0}"', '"say ""yes"" {0} no"', '5" wide', '"x"y', '"""{0}"""', "é" * 9, '"' + "long{0}" * 40 + '"']
    rows = [",".join([str(k), rng.choice(cells), rng.choice(cells)]) for k in range(400)] + ["", '400,"open until the end{0}', "of the file"]
    (tmp_path / "a.csv").write_text(("n,x,y{0}" + "{0}".join(rows)).format(end), encoding="utf-8", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = fc.read_feedback_csv(spark, str(tmp_path))
        rows = got.orderBy("_seq").collect()
        parts = got.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts > 4
    want = one_task(spark, tmp_path / "a.csv")
    # A line break in a cell is one character; the raw text of a record with too few or too many cells shows it so, too.
    want = [(*r[:3], r[3] and r[3].replace("\r\n", "\n")) for r in want]
    assert [tuple(r)[:4] for r in rows] == want and len({r._seq for r in rows}) == len(rows)
    assert [r.row_no for r in fc.record_numbers(got).orderBy("_seq").collect()] == list(range(1, len(want) + 1))


def test_quotes_at_line_ends():
    from tallyvox.sources.csv_records import ends_inside

    for line, outside, inside in [("a,b", 0, 1), ('"a', 1, 0), ('a"b', 0, 0), ('x,"', 1, 0), ('""', 0, 1), ('"a""', 1, 0), ('a",b', 0, 0), ('a","b', 1, 1), (' "a" x, "', 1, 1)]:
        assert (ends_inside(line, False), ends_inside(line, True)) == (bool(outside), bool(inside)), line


def test_manifest_reads_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fc, "BLOCK", 1000)
    (tmp_path / "a.CSV").write_bytes(bytes(range(256)) * 50)
    (tmp_path / "b c%20.csv").write_bytes(b"x")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "note.txt").write_bytes(b"y" * 1000)
    want = {(p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_size > 0 and p.name.lower().endswith(".csv")) for p in tmp_path.iterdir()}
    assert {tuple(r) for r in fc.file_manifest(spark, str(tmp_path)).collect()} == want
    monkeypatch.setattr(fc, "ARROW_SYSTEMS", set())
    assert {tuple(r) for r in fc.file_manifest(spark, str(tmp_path)).collect()} == want
