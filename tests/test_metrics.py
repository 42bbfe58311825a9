import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyvox.operators import baseline as bl
from tallyvox.operators import buckets as bk
from tallyvox.operators import dashboard as db
from tallyvox.operators import risk as rk
from tallyvox.operators.ordering import numbered


def days(spark, counts, key="a"):
    rows = [(1, key, dt.datetime(2024, 1, i + 1), n) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "ws long, canonical_key string, bucket_start timestamp, feedback_count long")


def test_fold(spark):
    rows = bl.ewma_baseline(days(spark, [10, 20, 5])).orderBy("bucket_start").collect()
    assert [round(r.ewma, 6) for r in rows] == [10, 13, 10.6]
    assert [round(r.variance, 6) for r in rows] == [0, 21, 28.14]
    assert [r.status for r in rows] == ["baseline_building", "baseline_building", "active"]


def test_continuing_from_saved_profiles(spark):
    every = days(spark, [10, 20, 5, 9, 30])
    whole = bl.ewma_baseline(every).orderBy("bucket_start").collect()[-1]
    first = bl.latest_profile(bl.ewma_baseline(every.filter("bucket_start < '2024-01-04'")))
    rest = bl.ewma_baseline(every.filter("bucket_start >= '2024-01-03'"), prior=first).orderBy("bucket_start").collect()
    assert len(rest) == 2 and abs(rest[-1].ewma - whole.ewma) < 1e-12 and rest[-1].active_buckets == 5


def test_first_day(spark):
    r = bl.issue_class(bl.ewma_baseline(days(spark, [3]))).first()
    assert (r.active_buckets, r.ewma, r.status, r.classification) == (1, 3.0, "baseline_building", "normal")


def test_supplied_profile_fires(spark):
    profile = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 9), 15, 4, 10.0, 4.0, 5, 10.0, 4.0, 2.0)],
        "ws long, canonical_key string, bucket_start timestamp, feedback_count long, prior_active int, prior_ewma double,"
        "prior_variance double, active_buckets int, ewma double, variance double, std double")
    r = bl.alert_detect(profile).first()
    assert r.fires and r.effective_threshold == 14


def test_cooldown(spark):
    fired = bl.alert_detect(bl.ewma_baseline(days(spark, [20, 60, 20, 90, 10])), against="prior")
    fired = fired.withColumn("fires", F.lit(True))
    assert [r.bucket_start.day for r in bl.alert_cooldown(fired).collect()] == [1]
    kept = bl.alert_cooldown(fired, hours=48, clock="bucket").collect()
    assert sorted(r.bucket_start.day for r in kept) == [1, 3, 5]
    recent = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 9, 1))], "ws long, canonical_key string, created_at timestamp")
    now = F.lit("2024-01-09 05:00:00").cast("timestamp")
    assert bl.alert_cooldown(fired, existing=recent, as_of=now).count() == 0


def test_merge_is_additive(spark):
    rows = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1, h), "s" + str(h % 2)) for h in range(6)],
        "ws long, canonical_key string, occurred_at timestamp, source_kind string")
    once = bk.bucket_counts(rows)
    merged = bk.bucket_merge(once, once).first()
    assert merged.feedback_count == 12 and merged.source_counts == {"s0": 6, "s1": 6}


def test_numbering_of_a_hot_group(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = numbered(rows, ["k"], ["id"], "n", partitions=7).filter("k = 'hot'").orderBy("id").collect()
    assert [r.n for r in got] == list(range(1, len(got) + 1))


def test_windows_and_ranges(spark):
    covered = spark.createDataFrame([(1, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 8, 12))], "ws long, start timestamp, end timestamp")
    r = db.analysis_window(covered, F.lit("2024-02-01").cast("timestamp")).first()
    assert r.window_start == dt.datetime(2024, 1, 5)
    with pytest.raises(Exception):
        stamp = F.lit("2024-01-01").cast("timestamp")
        db.half_open_range(covered, "start", stamp, stamp).collect()


def test_history_and_reconcile(spark):
    rows = [(1, "a", i, dt.datetime(2024, 1, 1 + i // 2), dt.datetime(2024, 1, 1), 5, 1.0, "ACTIVE") for i in range(8)]
    alerts = spark.createDataFrame(rows, "ws long, canonical_key string, alert_id long, created_at timestamp, bucket_start timestamp, current_count long, z_score double, status string")
    last = rk.alert_history(alerts).filter("alert_id = 7").first()
    assert [h.alert_id for h in last.history] == [6, 5, 4, 3, 2]
    claims = spark.createDataFrame([(1, 1, "本周 10 条工单", {"登录": 4})], "report_id long, ws long, summary string, mentions map<string,long>")
    facts = spark.createDataFrame([(1, 10, {"登录": 5})], "ws long, total long, issue_mentions map<string,long>")
    got = rk.reconcile(claims, facts).collect()
    assert not got[0].ok and [r.override for r in got] == [None, "5"] and all(r.passed for r in got)
