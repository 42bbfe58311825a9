"""Streams with events out of order."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tallyvox.operators import baseline as bl
from tallyvox.operators.buckets import bucket_counts
from tallyvox.session import checkpoint_dir
from tallyvox.sources.feedback_csv import ImportMapping
from tallyvox.sources.versions import Conflict, RunLog
from tallyvox.streaming import jobs

DAY = datetime.datetime(2024, 1, 1)


def cells(spark, batches, partitions=None):
    folder = f"{checkpoint_dir(spark)}/test-cells-{uuid.uuid4().hex}"
    schema = "ws long, event_id long, occurred_at timestamp, normalized_text string"
    for k, minutes in enumerate(batches):
        rows = [(1, 1000 * k + n, DAY + datetime.timedelta(minutes=m), "text") for n, m in enumerate(minutes)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        events = spark.readStream.schema(schema).parquet(f"{folder}/in")
        writer = jobs.stream_cells(events, f"{folder}/out", partitions=partitions)
        writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/out/cells").orderBy("cell_no")
    start = F.minute("window_start") + 60 * F.hour("window_start")
    return [(r.start, r.event_count) for r in found.select(start.alias("start"), "event_count").collect()]


def test_late_events_land_in_their_cell(spark):
    want = [(0, 2), (61, 1), (300, 1)]
    assert cells(spark, [[0, 55], [61], [300], [600]]) == want
    assert cells(spark, [[0], [61], [55], [300], [600]]) == want
    assert cells(spark, [[55, 61, 0], [600, 300], [601]]) == want


def test_one_workspace_in_several_tasks(spark):
    rng = random.Random(2)
    minutes = sorted(rng.sample(range(20_000), 2500))
    batches = [minutes[:900], minutes[900:1000], minutes[1000:], [40_000]]
    for b in batches[:3]:
        rng.shuffle(b)
    want, start, count = [], None, 0
    for m in minutes:
        if start is not None and (count == 40 or m - start >= 60):
            want.append((start, count))
            start = None
        start, count = (m, 1) if start is None else (start, count + 1)
    want.append((start, count))
    at = lambda m: (DAY + datetime.timedelta(minutes=m)).minute + 60 * (DAY + datetime.timedelta(minutes=m)).hour
    assert cells(spark, batches, partitions=5) == [(at(m), n) for m, n in want]


def drain(writer, folder):
    query = writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


MAPPING = ImportMapping("t", "at", "s", "ref", {})


def ingest(spark, folder, **options):
    writer = jobs.stream_ingest(spark, f"{folder}/in", MAPPING, ["t", "at", "s", "ref"], f"{folder}/events", F.lit(1), F.lit(1), **options)
    return drain(writer, folder)


def test_references_are_kept_in_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    when = "2024-01-01 00:00:00"
    for k in range(6):
        rows = [f"text {k} {r},{when},app,{r}" for r in (k, k, k + 1, "same")] + [f" ,{when},app,bad{k}", f"x,never,app,{k}"]
        (tmp_path / "in" / f"{k}.csv").write_text("t,at,s,ref\n" + "\n".join(rows) + "\n")
        done = ingest(spark, tmp_path, max_files=1)
        # Nothing is read but the new file: the state knows the references.
        assert done.lastProgress is None or done.lastProgress["numInputRows"] <= 6
    texts = sorted(r.normalized_text for r in spark.read.parquet(str(tmp_path / "events")).collect())
    assert texts == sorted(["text 0 0", "text 0 same", *(f"text {k} {k + 1}" for k in range(6))])
    bad = spark.read.parquet(str(tmp_path / "events_rejected"))
    assert sorted((r.batch_id, r._seq) for r in bad.collect()) == [(k, n) for k in range(6) for n in (4, 5)]


def test_first_record_of_a_batch_wins(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b", "a"):
        lines = [f"{name}{n},2024-01-01 00:00:00,app,r{n % 3}" for n in range(500)]
        (tmp_path / "in" / f"{name}.csv").write_text("t,at,s,ref\n" + "\n".join(lines) + "\n")
    ingest(spark, tmp_path)
    got = {r.normalized_text for r in spark.read.parquet(str(tmp_path / "events")).collect()}
    assert got == {"a0", "a1", "a2"}


def test_buckets_are_merged_behind_one_version(spark, tmp_path):
    target, schema = str(tmp_path / "out"), "ws long, canonical_key string, occurred_at timestamp, source_kind string"
    log, seen = RunLog(spark, target, fanout=3), None
    for k in range(11):
        rows = spark.createDataFrame([(1, "a", DAY, "app"), (1, f"k{k}", DAY, "web")], schema)
        log.append({"counts": bucket_counts(rows)}, k)
        log.append({"counts": bucket_counts(rows)}, k)  # the batch is run again
        if k == 8:
            seen = log.version()
            old = {r.canonical_key: r.feedback_count for r in jobs._merged_buckets(log, seen["runs"]).collect()}
        log.compact(lambda runs: {"counts": jobs._merged_buckets(log, runs)})
        if k == 8:  # a reader of the version before the merge still sees it whole
            assert old["a"] == 9
            assert {r.canonical_key: r.feedback_count for r in jobs._merged_buckets(log, seen["runs"]).collect()} == old
        assert len(log.version()["runs"]) <= 6
    got = {r.canonical_key: r.feedback_count for r in jobs.current_buckets(spark, target).collect()}
    assert got == {"a": 11, **{f"k{k}": 1 for k in range(11)}}
    assert len([n for n in log.files.names() if n.startswith("run-")]) <= 9


def test_two_writers_do_not_lose_a_commit(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    before = log.version()
    log.append({"t": spark.range(1)})
    with pytest.raises(Conflict):
        log._commit(before, [], 0)
    assert len(log.version()["runs"]) == 1


def test_profiles_are_kept_in_state(spark, tmp_path):
    schema = "ws long, canonical_key string, occurred_at timestamp"
    counts = {0: 4, 1: 6, 2: 5, 3: 30, 4: 5, 6: 40}
    for day, n in [*counts.items(), (1, 50), (20, 1)]:  # late events of a closed day are ignored
        stamp = DAY + datetime.timedelta(days=day, hours=3)
        spark.createDataFrame([(1, "k", stamp)] * n, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        links = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        drain(jobs.stream_baseline_alerts(links, f"{tmp_path}/out"), tmp_path)
    days = spark.createDataFrame([(1, "k", DAY + datetime.timedelta(days=d), n) for d, n in counts.items()], "ws long, canonical_key string, bucket_start timestamp, feedback_count long")
    states = bl.issue_class(bl.ewma_baseline(days))
    want = bl.alert_detect(states, against="prior").filter("fires").select("bucket_start", "feedback_count", "effective_threshold").collect()
    got = spark.read.parquet(f"{tmp_path}/out/alerts").select("bucket_start", "feedback_count", "effective_threshold").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 2
    profile = jobs.current_profiles(spark, f"{tmp_path}/progress").first()
    last = bl.latest_profile(states).first()
    assert (profile.active, profile.ewma, profile.variance) == (last.active_buckets, pytest.approx(last.ewma), pytest.approx(last.variance))
    assert not (tmp_path / "out" / "profiles").exists()
