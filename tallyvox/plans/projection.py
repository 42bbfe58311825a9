"""The whole projection: events to labels, facts, baselines, alerts and the risk queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.text import analysis_normalize
from tallyvox.operators import baseline as bl
from tallyvox.operators import buckets as bk
from tallyvox.operators import classify as cl
from tallyvox.operators import risk as rk
from tallyvox.operators.cells import Guards, assign_cells, cell_issues, cells_of
from tallyvox.session import materialize
from tallyvox.sources import fixed_rules as fixed
from tallyvox.sources.rule_tables import EXPRESSION_RULES, TOPIC_RULES, Rule


@dataclass(frozen=True)
class RuleSet:
    topics: list[Rule] = None
    expressions: list[Rule] = None
    synonyms: list[tuple[list[str], str]] = None
    lexicon: cl.Lexicon = None
    hit_order: str = "asc"

    def filled(self) -> "RuleSet":
        return RuleSet(
            self.topics or TOPIC_RULES,
            self.expressions or EXPRESSION_RULES,
            fixed.SYNONYMS if self.synonyms is None else self.synonyms,
            self.lexicon or cl.Lexicon(),
            self.hit_order,
        )


def project(events: DataFrame, rules: RuleSet = RuleSet(), guards: Guards = Guards()) -> dict[str, DataFrame]:
    """Every derived table of a projection, from one pass over the texts.

    Classified events are written once and read by all branches. Events carry their labels as an
    array, so links and buckets need no join back to the events.
    """
    rules = rules.filled()
    normalized = events.withColumn(
        "normalized_text", analysis_normalize(F.col("normalized_text"), rules.synonyms)
    )
    classified = materialize(
        cl.classify_events(normalized, rules.topics, rules.expressions, rules.lexicon, rules.hit_order)
    )
    links = cl.classified_links(classified)
    annotations = classified.select(
        "ws", "event_id", "occurred_at", "expression",
        F.col("expression_confidence").alias("confidence"), "mixed",
    )
    assigned = assign_cells(classified, guards)
    buckets = bk.bucket_counts(links)
    states = bl.issue_class(bl.ewma_baseline(buckets))
    alerts = bl.alert_cooldown(bl.alert_detect(states))
    queue = score_alerts(alerts)
    return {
        "links": links,
        "annotations": annotations,
        "review_candidates": cl.classified_reviews(classified),
        "cells": cells_of(assigned, guards),
        "cell_issues": cell_issues(assigned, links),
        "issue_buckets": buckets,
        "expression_buckets": bk.expression_daily_buckets(annotations),
        "baselines": bl.latest_profile(states),
        "alerts": alerts,
        "risk": queue,
    }


def score_alerts(alerts: DataFrame) -> DataFrame:
    rows = alerts.withColumn(
        "_r",
        rk.risk_score(
            F.col("z_score"),
            F.col("feedback_count"),
            rk.risk_weight(F.col("canonical_key")),
            F.lit(0),
        ),
    )
    return rows.withColumns({"risk_score": F.col("_r.score"), "risk_level": F.col("_r.level")}).drop("_r")


def alert_board(events: DataFrame, links: DataFrame, against: str = "prior") -> DataFrame:
    """Every topic day with class, alert flag, score and level, most urgent first."""
    buckets = bk.issue_daily_buckets(events, links)
    detected = bl.alert_detect(bl.issue_class(bl.ewma_baseline(buckets)), against=against)
    scored = score_alerts(detected)
    return scored.select(
        "ws", "canonical_key", "bucket_start", "feedback_count", "active_buckets",
        "baseline_ewma", "baseline_std", "classification", "z_score", "effective_threshold",
        "fires", "risk_score", "risk_level",
    ).orderBy(F.desc("fires"), F.desc("risk_score"), "ws", "canonical_key", "bucket_start")
