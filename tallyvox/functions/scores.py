"""Risk scores and figures read out of prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvox.functions.text import bind, contains_any

# Caps, levels and reason texts of the risk score.
SURGE_CAP = 40
VOLUME_CAP = 25
ISSUE_CAP = 20
AGE_CAP = 15
LEVELS = [("P0", 80), ("P1", 60), ("P2", 40)]
LOWEST_LEVEL = "P3"
POLICY_VERSION = "risk:v1"

# Topic key parts and their weight.
HEAVY_KEY_PARTS = ["login", "payment", "charge", "refund"]
MEDIUM_KEY_PARTS = ["crash", "stability"]

# Fixed value: a ticket count claimed in a summary.
CLAIM_END = "条工单"
CLAIM_PATTERN = rf"(共\s*(\d+)\s*条|\d+)\s*{CLAIM_END}"


def java_round(c: Column) -> Column:
    """Half up towards positive infinity."""
    return F.floor(c + F.lit(0.5))


def _between(c: Column, cap: int) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(0), c.cast("int")))


def risk_weight(key: Column) -> Column:
    return (
        F.when(contains_any(key, HEAVY_KEY_PARTS), F.lit(20))
        .when(contains_any(key, MEDIUM_KEY_PARTS), F.lit(15))
        .otherwise(F.lit(5))
    )


def risk_score(z: Column, count: Column, weight: Column, hours: Column) -> Column:
    surge = _between(java_round(z * 5), SURGE_CAP)
    volume = _between(count, VOLUME_CAP)
    issue = _between(weight, ISSUE_CAP)
    age = _between(hours, AGE_CAP)
    total = surge + volume + issue + age
    level = F.lit(LOWEST_LEVEL)
    for name, bound in reversed(LEVELS):
        level = F.when(total >= bound, F.lit(name)).otherwise(level)
    reasons = F.array_compact(
        F.array(
            F.when(surge >= 25, F.lit("异常强度高")).otherwise(F.lit("异常强度有限")),
            F.when(volume >= 20, F.lit("影响规模大")).otherwise(F.lit("影响规模小")),
            F.when(issue >= 15, F.lit("高风险主题")).otherwise(F.lit("一般风险主题")),
            F.when(
                age > 0, F.concat(F.lit("尚未开始跟进 "), age.cast("string"), F.lit(" 小时"))
            ),
        )
    )
    return F.struct(total.alias("score"), level.alias("level"), reasons.alias("reasons"))


def claimed_count(c: Column) -> Column:
    """First claimed ticket count, 0 when there is none or it is not a number."""
    text = F.coalesce(c, F.lit(""))
    inner = F.regexp_extract(text, CLAIM_PATTERN, 2)
    outer = F.regexp_extract(text, CLAIM_PATTERN, 1)
    digits = F.regexp_replace(bind(inner, lambda x: F.when(x != "", x).otherwise(outer)), r"\s", "")
    # The pattern is tried only on texts that hold its fixed end.
    return F.coalesce(F.when(text.contains(CLAIM_END), digits.try_cast("int")), F.lit(0))
