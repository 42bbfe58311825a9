"""Rule packs as tables and as the literals that classification folds into one expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvox.sources import fixed_rules as fixed

RULE_SCHEMA = (
    "pack_id string, canonical_key string, name string, priority int, rule_pos int, "
    "any_patterns array<string>, all_patterns array<string>, exclude_patterns array<string>"
)
TOPIC_SCHEMA = (
    "pack_id string, canonical_key string, name string, alert_eligible boolean, sort_order int"
)
SYNONYM_SCHEMA = "synonym_pos int, variants array<string>, target string"


@dataclass(frozen=True)
class Rule:
    canonical_key: str
    name: str
    priority: int
    any_patterns: list[str]
    all_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)


def as_rules(rows: list[tuple]) -> list[Rule]:
    return [Rule(*row) for row in rows]


TOPIC_RULES = as_rules(fixed.TOPIC_RULES)
EXPRESSION_RULES = as_rules(fixed.EXPRESSION_RULES)


def rules_frame(spark: SparkSession, rules: list[Rule], pack_id: str = fixed.DEFAULT_PACK_ID) -> DataFrame:
    rows = [
        (pack_id, r.canonical_key, r.name, r.priority, pos, r.any_patterns, r.all_patterns, r.exclude_patterns)
        for pos, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def topics_frame(
    spark: SparkSession, topics: list[tuple] = fixed.TOPICS, pack_id: str = fixed.DEFAULT_PACK_ID
) -> DataFrame:
    return spark.createDataFrame([(pack_id, *t) for t in topics], TOPIC_SCHEMA)


def rule_list(rules: DataFrame) -> list[Rule]:
    """Rules of one pack in order. A pack is configuration that people write, and read whole."""
    rows = rules.orderBy("rule_pos").collect()
    return [
        Rule(r.canonical_key, r.name, r.priority, r.any_patterns, r.all_patterns, r.exclude_patterns)
        for r in rows
    ]


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON-lines tables under `path`: rules/<pack>/, topics/<pack>/ and synonyms/.

    Directories starting with `_` are skipped by Spark itself. A pack without the general topic is
    rejected, and a topic listed twice keeps its first row.
    """
    rules = spark.read.schema(RULE_SCHEMA).option("recursiveFileLookup", "true").json(f"{path}/rules")
    topics = spark.read.schema(TOPIC_SCHEMA).option("recursiveFileLookup", "true").json(f"{path}/topics")
    synonyms = spark.read.schema(SYNONYM_SCHEMA).json(f"{path}/synonyms")
    checked = require_general_topic(topics)
    first = Window.partitionBy("pack_id", "canonical_key").orderBy("sort_order")
    ordered = (
        checked.withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .drop("_n")
        .orderBy("pack_id", "sort_order")
    )
    return rules, ordered, synonyms.orderBy("synonym_pos")


def require_general_topic(topics: DataFrame) -> DataFrame:
    missing = (
        topics.groupBy("pack_id")
        .agg(F.max((F.col("canonical_key") == fixed.GENERAL_TOPIC).cast("int")).alias("ok"))
        .filter("ok = 0")
        .limit(1)
        .collect()
    )
    if missing:
        raise ValueError(f"pack {missing[0].pack_id} lacks {fixed.GENERAL_TOPIC}")
    return topics


def resolve_pack(workspaces: DataFrame, packs: DataFrame, default_id: str) -> DataFrame:
    """Bound pack, or the default one where none is bound or the bound one is unknown."""
    known = packs.select("pack_id", "pack_version")
    fallback = packs.select(
        F.col("pack_id").alias("default_id"), F.col("pack_version").alias("default_version")
    )
    return (
        workspaces.withColumn("default_id", F.lit(default_id))
        .join(known, "pack_id", "left")
        .join(fallback, "default_id", "left")
        .select(
            "ws",
            F.when(F.col("pack_version").isNotNull(), F.col("pack_id"))
            .otherwise(F.col("default_id"))
            .alias("pack_id"),
            F.coalesce("pack_version", "default_version").alias("pack_version"),
        )
    )
