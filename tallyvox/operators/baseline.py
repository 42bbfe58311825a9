"""Exponentially weighted baselines, classes and alerts over daily buckets.

Days per topic are bounded by the calendar, so the ordered fold keeps one short array per topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.functions.scores import java_round

ISSUE = ["ws", "canonical_key"]


def ewma_baseline(
    buckets: DataFrame, alpha: float = 0.3, min_days: int = 3, prior: DataFrame | None = None
) -> DataFrame:
    """State before and after each day. `prior` holds saved profiles; their days are not redone."""
    days = F.array_sort(F.collect_list(F.struct("bucket_start", "feedback_count")))
    grouped = buckets.groupBy(*ISSUE).agg(days.alias("days"))
    if prior is not None:
        saved = prior.select(
            *ISSUE,
            F.col("active_buckets").alias("a0"),
            F.col("ewma").alias("e0"),
            F.col("variance").alias("v0"),
            F.col("last_bucket").alias("l0"),
        )
        grouped = grouped.join(saved, ISSUE, "left")
        days_left = F.filter(
            "days", lambda d: F.col("l0").isNull() | (d["bucket_start"] > F.col("l0"))
        )
        start = (F.coalesce("a0", F.lit(0)), F.coalesce("e0", F.lit(0.0)), F.coalesce("v0", F.lit(0.0)))
    else:
        days_left = F.col("days")
        start = (F.lit(0), F.lit(0.0), F.lit(0.0))

    def state(active: Column, ewma: Column, variance: Column) -> Column:
        return F.struct(
            active.cast("int").alias("active"), ewma.alias("ewma"), variance.alias("variance")
        )

    def step(s: Column, day: Column) -> Column:
        n = day["feedback_count"].cast("double")
        delta = n - s["ewma"]
        moved = state(
            s["active"] + 1,
            s["ewma"] + F.lit(alpha) * delta,
            F.lit(1 - alpha) * (s["variance"] + F.lit(alpha) * delta * delta),
        )
        return F.when(s["active"] == 0, state(F.lit(1), n, F.lit(0.0))).otherwise(moved)

    def fold(acc: Column, day: Column) -> Column:
        before = acc["now"]
        after = step(before, day)
        row = F.struct(
            day["bucket_start"].alias("bucket_start"),
            day["feedback_count"].alias("feedback_count"),
            before.alias("before"),
            after.alias("after"),
        )
        return F.struct(after.alias("now"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    state_type = "struct<active:int,ewma:double,variance:double>"
    count_type = buckets.schema["feedback_count"].dataType.simpleString()
    row_type = (
        f"struct<bucket_start:timestamp,feedback_count:{count_type},before:{state_type},after:{state_type}>"
    )
    zero = F.struct(state(*start).alias("now"), F.array().cast(f"array<{row_type}>").alias("rows"))
    # Outer, so that no inferred filter repeats the fold.
    folded = grouped.select(
        *ISSUE, F.inline_outer(F.aggregate(days_left, zero, fold)["rows"])
    ).filter(F.col("bucket_start").isNotNull())
    active = F.col("after.active")
    return folded.select(
        *ISSUE,
        "bucket_start",
        "feedback_count",
        F.col("before.active").alias("prior_active"),
        F.col("before.ewma").alias("prior_ewma"),
        F.col("before.variance").alias("prior_variance"),
        active.alias("active_buckets"),
        F.col("after.ewma").alias("ewma"),
        F.col("after.variance").alias("variance"),
        F.sqrt("after.variance").alias("std"),
        F.when(active >= min_days, F.lit("active"))
        .otherwise(F.lit("baseline_building"))
        .alias("status"),
    )


def latest_profile(baseline: DataFrame) -> DataFrame:
    """Profiles to save as `prior` of the next run."""
    return baseline.groupBy(*ISSUE).agg(
        F.max_by("active_buckets", "bucket_start").alias("active_buckets"),
        F.max_by("ewma", "bucket_start").alias("ewma"),
        F.max_by("variance", "bucket_start").alias("variance"),
        F.max_by("status", "bucket_start").alias("status"),
        F.max("bucket_start").alias("last_bucket"),
    )


def issue_class(
    baseline: DataFrame,
    surge_z: float = 2.0,
    surge_min: int = 5,
    chronic: float = 5.0,
    longtail: int = 2,
    min_days: int = 3,
) -> DataFrame:
    """Class of a day, judged with the state before it."""
    n, ewma = F.col("feedback_count"), F.col("prior_ewma")
    z = (n - ewma) / F.greatest(F.sqrt("prior_variance"), F.lit(1.0))
    young = (
        F.when(n >= surge_min, F.lit("surge"))
        .when(n <= longtail, F.lit("longtail"))
        .otherwise(F.lit("normal"))
    )
    label = (
        F.when(F.col("prior_active") < min_days, young)
        .when((ewma >= chronic) & (z < surge_z), F.lit("chronic"))
        .when(
            (z >= surge_z) & (n >= surge_min),
            F.when(ewma >= chronic, F.lit("escalating")).otherwise(F.lit("surge")),
        )
        .when((n <= longtail) & (ewma < chronic), F.lit("longtail"))
        .otherwise(F.lit("normal"))
    )
    return baseline.withColumn("classification", label)


def alert_detect(
    baseline: DataFrame, threshold: int = 10, surge_z: float = 2.0, against: str = "post"
) -> DataFrame:
    """z-score, effective threshold and whether the day fires.

    `against="post"` compares with the state that already contains the day; "prior" with the state
    before it (a first day, which has none, is compared with itself as in "post").
    """
    if against not in ("post", "prior"):
        raise ValueError(against)
    first = F.col("prior_active") == 0
    if against == "post":
        ewma, std = F.col("ewma"), F.col("std")
    else:
        ewma = F.when(first, F.col("ewma")).otherwise(F.col("prior_ewma"))
        std = F.when(first, F.col("std")).otherwise(F.sqrt("prior_variance"))
    n = F.col("feedback_count")
    effective = F.greatest(F.lit(threshold), java_round(ewma + F.lit(surge_z) * std).cast("int"))
    return baseline.withColumns(
        {
            "baseline_ewma": ewma,
            "baseline_std": std,
            "z_score": (n - ewma) / F.greatest(std, F.lit(1.0)),
            "effective_threshold": effective,
            "fires": n >= effective,
        }
    )


def alert_cooldown(
    alerts: DataFrame,
    hours: int = 6,
    clock: str = "run",
    existing: DataFrame | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Alerts that survive the cooldown.

    "run": alerts of one run share one creation time, so the first firing day per topic stays,
    unless an `existing(ws, canonical_key, created_at)` alert is younger than `hours` at `as_of`.
    "bucket": the cooldown counts from the last kept alert's day.
    """
    fired = alerts.filter("fires")
    if clock == "run":
        kept = fired.groupBy(*ISSUE).agg(F.min("bucket_start").alias("bucket_start"))
        if existing is not None:
            last = existing.groupBy(*ISSUE).agg(F.max("created_at").alias("_last"))
            age = F.floor((F.unix_micros(as_of) - F.unix_micros("_last")) / F.lit(3_600_000_000))
            kept = (
                kept.join(last, ISSUE, "left")
                .filter(F.col("_last").isNull() | (age >= hours))
                .drop("_last")
            )
    elif clock == "bucket":
        days = F.array_sort(F.collect_list("bucket_start"))
        none = F.array().cast("array<timestamp>")

        def keep(acc: Column, day: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            due = last.isNull() | (
                F.floor((F.unix_micros(day) - F.unix_micros(last)) / F.lit(3_600_000_000)) >= hours
            )
            return F.when(due, F.concat(acc, F.array(day))).otherwise(acc)

        kept = (
            fired.groupBy(*ISSUE)
            .agg(days.alias("days"))
            .select(*ISSUE, F.explode(F.aggregate("days", none, keep)).alias("bucket_start"))
        )
    else:
        raise ValueError(clock)
    return fired.join(kept, [*ISSUE, "bucket_start"], "left_semi")


def alert_evidence(alerts: DataFrame) -> DataFrame:
    document = F.struct(
        F.date_format("bucket_start", "yyyy-MM-dd'T'HH:mm'Z'").alias("bucket_start"),
        F.col("feedback_count").alias("current_count"),
        "baseline_ewma",
        "baseline_std",
        "z_score",
        "effective_threshold",
        "active_buckets",
        "classification",
    )
    return alerts.withColumn("evidence_json", F.to_json(document))


def baseline_status(baseline: DataFrame) -> DataFrame:
    newest = Window.partitionBy(*ISSUE).orderBy(F.desc("bucket_start"))
    last = baseline.withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
    return last.groupBy("ws").agg(
        F.count_if(F.col("status") == "baseline_building").alias("building"),
        F.count_if(F.col("status") == "active").alias("active"),
    )
