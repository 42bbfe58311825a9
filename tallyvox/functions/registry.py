"""The same functions for SQL users, as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BODIES = {
    "pii_mask(x STRING)": (
        "STRING",
        r"""regexp_replace(regexp_replace(x, r'(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[EMAIL]'),
            r'(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d{9}(?!\d)', '[PHONE]')""",
    ),
    "import_normalize(x STRING)": (
        "STRING",
        r"lower(regexp_replace(regexp_replace(x, r'^[\x00-\x20]+|[\x00-\x20]+$', ''), r'\s+', ' '))",
    ),
    "token_estimate(x STRING)": (
        "INT",
        r"""CASE WHEN coalesce(x, '') = '' THEN 1 ELSE
            CAST(floor(regexp_count(x, r'[一-鿿]') / 1.5D + (length(x)
            + regexp_count(x, r'[\x{10000}-\x{10FFFF}]') - regexp_count(x, r'[一-鿿]')) / 4.0D) AS INT)
            + 1 END""",
    ),
    "answer_normalize(x STRING)": (
        "STRING",
        r"regexp_replace(translate(lower(coalesce(x, '')), '-_', ''), r'[\s，。；、：！？,.!?;:]', '')",
    ),
    "cosine_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": (
        "DOUBLE",
        """1.0D - aggregate(zip_with(a, b, (u, v) -> double(u) * double(v)), 0.0D, (s, v) -> s + v)
           / (sqrt(aggregate(transform(a, u -> double(u) * double(u)), 0.0D, (s, v) -> s + v))
            * sqrt(aggregate(transform(b, u -> double(u) * double(u)), 0.0D, (s, v) -> s + v)))""",
    ),
    "risk_weight(k STRING)": (
        "INT",
        """CASE WHEN k LIKE '%login%' OR k LIKE '%payment%' OR k LIKE '%charge%' OR k LIKE '%refund%' THEN 20
                WHEN k LIKE '%crash%' OR k LIKE '%stability%' THEN 15 ELSE 5 END""",
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    for signature, (kind, body) in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [signature.split("(")[0] for signature in _BODIES]
