"""The given tables cast into the roles the operators read, once in Spark and once in SQL.

`CTES` holds the SQL side; `with_tables` prepends what a query names, in dependency order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.operators.corpus import chunk_documents
from tallyvox.operators.evaluation import QUESTION_TYPES
from tallyvox.operators.search import vector_arm

LABELS = ["expr_suggestion", "expr_complaint", "expr_praise", "expr_neutral", "expr_other"]
AS_OF = "2024-02-01 00:00:00"
DOCUMENT_TYPES = [
    "RELEASE_NOTE", "KNOWN_ISSUE", "SUPPORT_SOP", "SENTIMENT_PLAYBOOK", "OPERATION_EVENT", "POSTMORTEM",
]

IDS_PER_PARENT = 1 << 24  # turns of a conversation and chunks of a document; a text of 15 GB has fewer chunks

CTES: dict[str, str] = {}
SHARED = {"t_pairs", "t_near", "t_near_full", "t_near_half", "t_ranked"}  # costly, and read several times


def with_tables(body: str, recursive: bool = False) -> str:
    """The named CTEs that `body` mentions, and those they mention, then `body`."""
    wanted: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(CTES[name])
                wanted.append(name)

    visit(body)
    body = body.strip()
    parts = [f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({CTES[n].strip()})" for n in wanted]
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("WITH RECURSIVE "):
        return head + ", ".join([*parts, body[len("WITH RECURSIVE "):]])
    if body.upper().startswith("WITH "):
        return head + ", ".join([*parts, body[len("WITH "):]])
    return (head + ", ".join(parts) + " " + body) if parts else body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


# --- feedback ------------------------------------------------------------------------------

CTES["t_events"] = """
SELECT user_id % 4 AS ws, event_id, ts AS occurred_at, 's' || (user_id % 5) AS source_kind,
       props AS sanitized_text, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
       event_type, value
FROM events"""


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("ws"),
        "event_id",
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source_kind"),
        F.col("props").alias("sanitized_text"),
        F.col("props").alias("normalized_text"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
        "event_type",
        "value",
    )


CTES["t_links"] = """
SELECT ws, event_id, occurred_at, source_kind, event_type AS canonical_key, 1 AS rank,
       'rule' AS method, 1.0 AS confidence,
       CASE k % 4 WHEN 0 THEN 'mixed' WHEN 1 THEN 'positive' WHEN 2 THEN 'negative' ELSE 'neutral' END AS sentiment
FROM t_events
UNION ALL
SELECT ws, event_id, occurred_at, source_kind, 'payment', 2,
       CASE WHEN k % 2 = 0 THEN 'ambiguous' ELSE 'rule' END,
       CASE WHEN k % 2 = 0 THEN 0.5 ELSE 1.0 END, 'neutral'
FROM t_events WHERE k % 3 = 0"""


def links(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    first = F.struct(
        F.col("event_type").alias("canonical_key"),
        F.lit(1).alias("rank"),
        F.lit("rule").alias("method"),
        F.lit(1.0).alias("confidence"),
        F.when(k % 4 == 0, "mixed")
        .when(k % 4 == 1, "positive")
        .when(k % 4 == 2, "negative")
        .otherwise("neutral")
        .alias("sentiment"),
    )
    second = F.struct(
        F.lit("payment").alias("canonical_key"),
        F.lit(2).alias("rank"),
        F.when(k % 2 == 0, "ambiguous").otherwise("rule").alias("method"),
        F.when(k % 2 == 0, F.lit(0.5)).otherwise(F.lit(1.0)).alias("confidence"),
        F.lit("neutral").alias("sentiment"),
    )
    both = F.array_compact(F.array(first, F.when(k % 3 == 0, second)))
    return feedback(spark, sf).select(
        "ws", "event_id", "occurred_at", "source_kind", F.inline(both)
    )


CTES["t_annotations"] = """
SELECT ws, event_id, occurred_at,
       CASE k % 5 WHEN 0 THEN 'expr_suggestion' WHEN 1 THEN 'expr_complaint' WHEN 2 THEN 'expr_praise'
                  WHEN 3 THEN 'expr_neutral' ELSE 'expr_other' END AS expression
FROM t_events"""


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("k") % 5 + 1).cast("int"))
    return feedback(spark, sf).select("ws", "event_id", "occurred_at", label.alias("expression"))


CTES["t_buckets"] = """
SELECT ws, canonical_key, date_trunc('day', occurred_at)::TIMESTAMP AS bucket_start, count(*) AS feedback_count
FROM t_links GROUP BY ALL"""


def buckets(spark: SparkSession, sf: str) -> DataFrame:
    from tallyvox.operators.buckets import bucket_counts

    return bucket_counts(links(spark, sf))


CTES["t_assigned"] = """
SELECT ws, event_id, occurred_at, CAST(floor(epoch(occurred_at) / 3600) AS BIGINT) AS cell_no FROM t_events"""
CTES["t_cells"] = """
SELECT ws, cell_no, min(occurred_at) AS window_start, max(occurred_at) AS window_end, count(*) AS event_count
FROM t_assigned GROUP BY ws, cell_no"""
CTES["t_cell_issues"] = """
SELECT a.ws, a.cell_no, l.canonical_key, count(*) AS mention_count,
       list(a.event_id ORDER BY a.occurred_at, a.event_id)[1:5] AS sample_event_ids
FROM t_assigned a JOIN t_links l USING (event_id) GROUP BY a.ws, a.cell_no, l.canonical_key"""


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.floor(F.unix_micros("occurred_at") / F.lit(3_600_000_000))
    return feedback(spark, sf).withColumn("cell_no", hour)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return assigned(spark, sf).groupBy("ws", "cell_no").agg(
        F.min("occurred_at").alias("window_start"),
        F.max("occurred_at").alias("window_end"),
        F.count(F.lit(1)).alias("event_count"),
    )


def issues_of_cells(spark: SparkSession, sf: str) -> DataFrame:
    from tallyvox.operators.cells import cell_issues

    return cell_issues(assigned(spark, sf), links(spark, sf).select("event_id", "canonical_key"))


CTES["t_window"] = """
SELECT ws, greatest(max(window_end) - INTERVAL 7 DAY, min(window_start)) AS w0, max(window_end) AS w1
FROM t_cells GROUP BY ws"""


def window(spark: SparkSession, sf: str) -> DataFrame:
    from tallyvox.operators.dashboard import analysis_window, coverage

    return analysis_window(coverage(cells(spark, sf)), as_of())


CTES["t_catalog"] = """
SELECT ws, canonical_key, upper(canonical_key) AS canonical_name, min(occurred_at) AS first_seen,
       max(occurred_at) AS last_seen
FROM t_links GROUP BY ws, canonical_key"""


def topic_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return links(spark, sf).groupBy("ws", "canonical_key").agg(
        F.upper("canonical_key").alias("canonical_name"),
        F.min("occurred_at").alias("first_seen"),
        F.max("occurred_at").alias("last_seen"),
    )


# --- alerts --------------------------------------------------------------------------------

CTES["t_alerts"] = """
SELECT b.ws, b.canonical_key, b.ws || '-' || b.canonical_key || '-' || strftime(b.bucket_start, '%Y%m%d') AS alert_id,
       b.bucket_start, b.feedback_count AS current_count, s.m AS ewma, s.d AS std,
       2 * (b.feedback_count - s.m) / greatest(s.d, 1.0) AS z_score,
       CAST(floor(s.m + 2 * s.d + 0.5) AS BIGINT) AS effective_threshold, 'ACTIVE' AS status,
       b.bucket_start + INTERVAL 1 DAY AS created_at
FROM t_buckets b JOIN (SELECT ws, canonical_key, avg(feedback_count) AS m, stddev_pop(feedback_count) AS d
                       FROM t_buckets GROUP BY ws, canonical_key) s
  ON b.ws = s.ws AND b.canonical_key = s.canonical_key
WHERE b.feedback_count >= s.m + 0.5 * s.d"""


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    days = buckets(spark, sf).drop("source_counts")
    key = ["ws", "canonical_key"]
    stats = days.groupBy(*key).agg(
        F.avg("feedback_count").alias("ewma"), F.stddev_pop("feedback_count").alias("std")
    )
    rows = days.join(stats, key)
    day = F.date_format("bucket_start", "yyyyMMdd")
    return rows.filter(F.col("feedback_count") >= F.col("ewma") + 0.5 * F.col("std")).select(
        *key,
        F.concat_ws("-", F.col("ws").cast("string"), "canonical_key", day).alias("alert_id"),
        "bucket_start",
        F.col("feedback_count").alias("current_count"),
        "ewma",
        "std",
        (2 * (F.col("feedback_count") - F.col("ewma")) / F.greatest("std", F.lit(1.0))).alias("z_score"),
        F.floor(F.col("ewma") + 2 * F.col("std") + 0.5).alias("effective_threshold"),
        F.lit("ACTIVE").alias("status"),
        (F.col("bucket_start") + F.expr("INTERVAL 1 DAY")).alias("created_at"),
    )


CTES["t_snapshots"] = """
SELECT ws, alert_id, s AS score,
       CASE WHEN s >= 80 THEN 'P0' WHEN s >= 60 THEN 'P1' WHEN s >= 40 THEN 'P2' ELSE 'P3' END AS level,
       CASE WHEN surge >= 25 THEN '异常强度高' ELSE '异常强度有限' END || '；' ||
       CASE WHEN volume >= 20 THEN '影响规模大' ELSE '影响规模小' END || '；' ||
       CASE WHEN issue >= 15 THEN '高风险主题' ELSE '一般风险主题' END AS reasons,
       'risk:v1' AS policy_version
FROM (SELECT *, surge + volume + issue AS s FROM (
  SELECT ws, alert_id,
         least(40, greatest(0, CAST(floor(z_score * 5 + 0.5) AS BIGINT))) AS surge,
         least(25, greatest(0, current_count)) AS volume,
         CASE WHEN canonical_key LIKE '%login%' OR canonical_key LIKE '%payment%'
                OR canonical_key LIKE '%charge%' OR canonical_key LIKE '%refund%' THEN 20
              WHEN canonical_key LIKE '%crash%' OR canonical_key LIKE '%stability%' THEN 15 ELSE 5 END AS issue
  FROM t_alerts) q) r"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    from tallyvox.operators.risk import risk_snapshot

    rows = alerts(spark, sf)
    return risk_snapshot(rows, rows.select("ws", "alert_id").limit(0))


CTES["t_cases"] = """
SELECT ws, alert_id, 'c-' || alert_id AS case_id,
       CASE WHEN current_count % 2 = 0 THEN 'CONFIRMED' ELSE 'OPEN' END AS status,
       created_at, created_at + to_hours(CAST(current_count AS INTEGER)) AS updated_at,
       CASE WHEN current_count % 2 = 1 THEN 'AWAITING' ELSE 'DONE' END AS follow_up_status,
       CASE WHEN current_count % 5 = 0 THEN created_at END AS reminded_at
FROM t_alerts WHERE current_count % 3 <> 0"""


def cases_of_alerts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("current_count")
    return alerts(spark, sf).filter(n % 3 != 0).select(
        "ws",
        "alert_id",
        F.concat(F.lit("c-"), "alert_id").alias("case_id"),
        F.when(n % 2 == 0, "CONFIRMED").otherwise("OPEN").alias("status"),
        "created_at",
        (F.col("created_at") + F.make_dt_interval(hours=n.cast("int"))).alias("updated_at"),
        F.when(n % 2 == 1, "AWAITING").otherwise("DONE").alias("follow_up_status"),
        F.when(n % 5 == 0, F.col("created_at")).alias("reminded_at"),
    )


# --- runs and conversations ----------------------------------------------------------------

CTES["t_runs"] = """
SELECT o_custkey % 4 AS ws, o_orderkey AS run_id, o_orderpriority AS agent_type, o_orderstatus AS prompt_version,
       'm' || (o_custkey % 2) AS model_name,
       CASE WHEN o_custkey % 10 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
       CAST(floor(o_totalprice) AS BIGINT) AS latency_ms,
       CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey % 1000 END AS prompt_tokens,
       o_orderkey % 500 AS completion_tokens, o_orderdate AS created_at
FROM orders"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 4).alias("ws"),
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("agent_type"),
        F.col("o_orderstatus").alias("prompt_version"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 2).cast("string")).alias("model_name"),
        F.when(F.col("o_custkey") % 10 == 0, "failed").otherwise("succeeded").alias("status"),
        F.floor("o_totalprice").alias("latency_ms"),
        F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderkey") % 1000).alias("prompt_tokens"),
        (F.col("o_orderkey") % 500).alias("completion_tokens"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


CTES["t_messages"] = """
SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations WHERE role <> 'system'"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").filter(F.col("role") != "system").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
    )


CTES["t_questions"] = """
SELECT conv_id * 16777216 + turn AS question_id, conv_id AS session_id,
       CASE turn % 8 WHEN 0 THEN '这个' || text WHEN 1 THEN '继续 ' || text WHEN 2 THEN text || ' 版本 v1.2.3'
            WHEN 3 THEN text || ' 为什么' WHEN 4 THEN '里面' || text || ' 趋势' WHEN 5 THEN text || ' 近7天'
            WHEN 6 THEN text || ' 建议' ELSE '上周' || text END AS text
FROM conversations"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    turn, text = F.col("turn") % 8, F.col("text")
    marked = (
        F.when(turn == 0, F.concat(F.lit("这个"), text))
        .when(turn == 1, F.concat(F.lit("继续 "), text))
        .when(turn == 2, F.concat(text, F.lit(" 版本 v1.2.3")))
        .when(turn == 3, F.concat(text, F.lit(" 为什么")))
        .when(turn == 4, F.concat(F.lit("里面"), text, F.lit(" 趋势")))
        .when(turn == 5, F.concat(text, F.lit(" 近7天")))
        .when(turn == 6, F.concat(text, F.lit(" 建议")))
        .otherwise(F.concat(F.lit("上周"), text))
    )
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * IDS_PER_PARENT + F.col("turn")).alias("question_id"),
        F.col("conv_id").alias("session_id"),
        marked.alias("text"),
    )


# --- corpus --------------------------------------------------------------------------------

_TYPES_SQL = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(DOCUMENT_TYPES))
CTES["t_docs"] = f"""
SELECT doc_id AS document_id, source || ' ' || lang || ' v1.' || (doc_id % 9) AS title,
       CASE doc_id % 6 {_TYPES_SQL} END AS document_type, doc_id % 2 AS org_id,
       CASE WHEN doc_id % 3 <> 0 THEN doc_id % 4 END AS target_ws, text, source AS category
FROM documents"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(t) for t in DOCUMENT_TYPES])
    return table(spark, sf, "documents").select(
        i.alias("document_id"),
        F.concat(F.concat_ws(" ", "source", "lang"), F.lit(" v1."), (i % 9).cast("string")).alias("title"),
        F.element_at(kinds, (i % 6 + 1).cast("int")).alias("document_type"),
        (i % 2).alias("org_id"),
        F.when(i % 3 != 0, i % 4).alias("target_ws"),
        "text",
        F.col("source").alias("category"),
    )


CTES["t_versions"] = """
SELECT doc_id AS document_id, version_no, doc_id * 10 + version_no AS version_id,
       CASE WHEN version_no = 1 + doc_id % 3 THEN 'PUBLISHED' ELSE 'EXPIRED' END AS status,
       CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) END AS effective_from,
       CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-15' + to_days(CAST(doc_id % 60 AS INTEGER)) END AS effective_to,
       TIMESTAMP '2024-01-01' + to_days(CAST(version_no * 7 AS INTEGER)) AS published_at,
       CASE WHEN doc_id % 7 <> 0 THEN 'owner' || (doc_id % 7) END AS owner,
       CASE WHEN doc_id % 11 = 0 THEN source END AS fact_boundary
FROM (SELECT *, unnest(generate_series(1, 1 + doc_id % 3)) AS version_no FROM documents) v"""


def versions(spark: SparkSession, sf: str) -> DataFrame:
    i, v = F.col("doc_id"), F.col("version_no")
    days = lambda n: F.make_dt_interval(days=n.cast("int"))
    stamp = lambda s: F.lit(s).cast("timestamp")
    numbers = F.explode(F.sequence(F.lit(1).cast("long"), 1 + i % 3)).alias("version_no")
    return table(spark, sf, "documents").select("doc_id", "source", numbers).select(
        i.alias("document_id"),
        "version_no",
        (i * 10 + v).alias("version_id"),
        F.when(v == 1 + i % 3, "PUBLISHED").otherwise("EXPIRED").alias("status"),
        F.when(i % 4 != 0, stamp("2024-01-01") + days(i % 60)).alias("effective_from"),
        F.when(i % 5 == 0, stamp("2024-01-15") + days(i % 60)).alias("effective_to"),
        (stamp("2024-01-01") + days(v * 7)).alias("published_at"),
        F.when(i % 7 != 0, F.concat(F.lit("owner"), (i % 7).cast("string"))).alias("owner"),
        F.when(i % 11 == 0, F.col("source")).alias("fact_boundary"),
    )


def chunk_sql(source: str, key: str) -> str:
    """Chunking in SQL over a (key, text) relation."""
    edge = r"'^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'"
    return rf"""
WITH raw AS (SELECT {key}, regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '\r', chr(10), 'g') AS t FROM ({source}) s),
trimmed AS (SELECT {key}, regexp_replace(t, {edge}) AS t FROM raw),
plain AS (SELECT {key}, regexp_replace(regexp_replace(t, '\A---\s*\n(?s:.*?)\n---\s*(?:\n|\z)', ''), {edge}) AS t
          FROM trimmed WHERE t <> ''),
lines AS (SELECT {key}, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS ln FROM plain),
marked AS (SELECT *, regexp_matches(regexp_replace(line, {edge}), '^#{{1,3}}\s+.+$') AS is_head FROM lines),
placed AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY {key} ORDER BY ln) AS section FROM marked),
sections AS (SELECT {key}, section,
    max(CASE WHEN is_head THEN regexp_replace(regexp_replace(regexp_replace(line, {edge}), '^#{{1,3}}\s+', ''), {edge}) END) AS heading,
    regexp_replace(coalesce(string_agg(CASE WHEN NOT is_head THEN line END, chr(10) ORDER BY ln), ''), {edge}) AS body,
    max(is_head::INT) AS titled FROM placed GROUP BY {key}, section),
kept AS (SELECT *, max(titled) OVER (PARTITION BY {key}) AS any_titled FROM sections),
cut AS (SELECT {key}, section, CASE WHEN heading IS NULL AND any_titled = 1 THEN '文档导语' ELSE heading END AS section_heading, body,
    unnest(CASE WHEN length(body) <= 1000 THEN [0] ELSE generate_series(0, greatest(length(body) - 101, 0), 900) END) AS cut_at
    FROM kept WHERE body <> '')
SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY section, cut_at) AS chunk_no,
       CASE WHEN length(body) <= 1000 THEN body ELSE substring(body, CAST(cut_at + 1 AS BIGINT), 1000) END AS content,
       section_heading
FROM cut"""


CTES["t_pieces"] = chunk_sql("SELECT doc_id AS document_id, text FROM documents", "document_id")
CTES["t_chunks"] = """
SELECT document_id, 1 + document_id % 3 AS version_no, document_id * 10 + 1 + document_id % 3 AS version_id,
       chunk_no, document_id * 16777216 + chunk_no AS chunk_id, content,
       CASE WHEN chunk_no % 5 <> 0 THEN 'part ' || (chunk_no // 3) END AS section_heading
FROM t_pieces"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    pieces = chunk_documents(table(spark, sf, "documents").withColumnRenamed("doc_id", "document_id"))
    i, n = F.col("document_id"), F.col("chunk_no").cast("bigint")
    part = F.concat(F.lit("part "), F.floor(n / 3).cast("string"))
    return pieces.select(
        "document_id",
        (1 + i % 3).alias("version_no"),
        (i * 10 + 1 + i % 3).alias("version_id"),
        n.alias("chunk_no"),
        (i * IDS_PER_PARENT + n).alias("chunk_id"),
        "content",
        F.when(n % 5 != 0, part).alias("section_heading"),
    )


CTES["t_items"] = """
SELECT c.*, d.title, d.document_type, CAST(NULL AS VARCHAR) AS lexical_text
FROM t_chunks c JOIN t_docs d USING (document_id)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with the document columns retrieval shows."""
    heads = docs(spark, sf).select("document_id", "title", "document_type")
    return chunks(spark, sf).join(heads, "document_id").withColumn(
        "lexical_text", F.lit(None).cast("string")
    )


# --- retrieval over embeddings -------------------------------------------------------------

CTES["t_pairs"] = """
SELECT a.vec_id AS query_id, b.vec_id AS chunk_id,
       round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS full_score,
       round(list_cosine_similarity(a.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[]), 9) AS half_score
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"""
CTES["t_near"] = """
SELECT query_id, chunk_id, full_score AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY full_score DESC, chunk_id) AS rank FROM t_pairs) q
WHERE rank <= 50"""
CTES["t_near_half"] = """
SELECT query_id, chunk_id, half_score AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY half_score DESC, chunk_id) AS rank FROM t_pairs) q
WHERE rank <= 40"""
CTES["t_near_full"] = "SELECT * FROM t_near WHERE rank <= 40"


def near(spark: SparkSession, sf: str, k: int = 50, dimensions: int | None = None) -> DataFrame:
    """Every vector's nearest others. The first `dimensions` only, to get a second ranking."""
    vectors = table(spark, sf, "embeddings")
    if dimensions:
        vectors = vectors.withColumn("embedding", F.slice("embedding", 1, dimensions))
    return vector_arm(
        vectors.select(F.col("vec_id").alias("query_id"), "embedding"),
        vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"),
        k,
        exclude_same_id=True,
    )


# --- gold dataset over embeddings ----------------------------------------------------------

_QTYPES_SQL = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(QUESTION_TYPES))
CTES["t_gold"] = f"""
SELECT 'dev-' || vec_id AS case_key, vec_id, 'ds-' || label AS dataset_key,
       CASE vec_id % 8 {_QTYPES_SQL} END AS question_type,
       CASE vec_id % 3 WHEN 0 THEN 'EASY' WHEN 1 THEN 'MEDIUM' ELSE 'HARD' END AS difficulty,
       vec_id % 8 >= 5 AS should_refuse, 'question ' || vec_id AS question_text, vec_id AS sort_order,
       'reviewer' || (vec_id % 10) AS reviewer
FROM embeddings"""


def gold(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id")
    pick = lambda values, n: F.element_at(
        F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int")
    )
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("dev-"), i.cast("string")).alias("case_key"),
        "vec_id",
        F.concat(F.lit("ds-"), F.col("label").cast("string")).alias("dataset_key"),
        pick(QUESTION_TYPES, 8).alias("question_type"),
        pick(["EASY", "MEDIUM", "HARD"], 3).alias("difficulty"),
        (i % 8 >= 5).alias("should_refuse"),
        F.concat(F.lit("question "), i.cast("string")).alias("question_text"),
        i.alias("sort_order"),
        F.concat(F.lit("reviewer"), (i % 10).cast("string")).alias("reviewer"),
    )


CTES["t_ranked"] = """
SELECT 'dev-' || query_id AS case_key, query_id, rank, chunk_id // 8 AS document_id, (chunk_id // 4) % 2 + 1 AS version_no, chunk_id
FROM t_near"""


def ranked_ids(spark: SparkSession, sf: str, k: int = 50, found: DataFrame | None = None) -> DataFrame:
    """The lists of `near`, or of `found` where it was made before."""
    c = F.col("chunk_id")
    return (found if found is not None else near(spark, sf, k)).select(
        F.concat(F.lit("dev-"), F.col("query_id").cast("string")).alias("case_key"),
        "query_id",
        "rank",
        F.floor(c / 8).alias("document_id"),
        (F.floor(c / 4) % 2 + 1).alias("version_no"),
        "chunk_id",
    )


CTES["t_evidence"] = """
SELECT g.case_key, 0 AS sort_order, 'CHUNK' AS granularity, r.document_id, r.version_no, r.chunk_id, 'r1' AS requirement_key
FROM t_gold g JOIN t_ranked r ON r.case_key = g.case_key AND r.rank = 1 + g.vec_id % 24
WHERE g.question_type NOT IN ('CHITCHAT', 'NO_ANSWER')
UNION ALL
SELECT case_key, 1, 'DOCUMENT', vec_id // 8, 1, NULL, CASE WHEN vec_id % 2 = 0 THEN 'r1' ELSE 'r2' END
FROM t_gold WHERE question_type NOT IN ('CHITCHAT', 'NO_ANSWER')
UNION ALL
SELECT case_key, 2, 'VERSION', vec_id // 8, (vec_id // 4) % 2 + 1, NULL, ''
FROM t_gold WHERE question_type NOT IN ('CHITCHAT', 'NO_ANSWER') AND vec_id % 3 = 0"""


def evidence(spark: SparkSession, sf: str, ranked: DataFrame | None = None) -> DataFrame:
    cases = gold(spark, sf).filter(~F.col("question_type").isin("CHITCHAT", "NO_ANSWER"))
    i = F.col("vec_id")
    hit = cases.select("case_key", (1 + i % 24).cast("int").alias("rank")).join(
        ranked if ranked is not None else ranked_ids(spark, sf), ["case_key", "rank"]
    )
    none = F.lit(None).cast("bigint")
    first = hit.select(
        "case_key", F.lit(0).alias("sort_order"), F.lit("CHUNK").alias("granularity"),
        "document_id", "version_no", "chunk_id", F.lit("r1").alias("requirement_key"),
    )
    second = F.struct(
        F.lit(1).alias("sort_order"), F.lit("DOCUMENT").alias("granularity"),
        F.floor(i / 8).alias("document_id"), F.lit(1).cast("bigint").alias("version_no"),
        none.alias("chunk_id"),
        F.when(i % 2 == 0, "r1").otherwise("r2").alias("requirement_key"),
    )
    third = F.struct(
        F.lit(2).alias("sort_order"), F.lit("VERSION").alias("granularity"),
        F.floor(i / 8).alias("document_id"), (F.floor(i / 4) % 2 + 1).alias("version_no"),
        none.alias("chunk_id"), F.lit("").alias("requirement_key"),
    )
    both = F.array_compact(F.array(second, F.when(i % 3 == 0, third)))
    return first.unionByName(cases.select("case_key", F.inline(both)))


CTES["t_assertions"] = """
SELECT g.case_key, 0 AS sort_order, 'REQUIRED_FACT' AS assertion_type, d.text AS assertion_text, 1 + g.vec_id % 3 AS weight
FROM t_gold g JOIN documents d ON d.doc_id = g.vec_id
UNION ALL
SELECT g.case_key, 1, 'REQUIRED_FACT', d.text, g.vec_id % 5
FROM t_gold g JOIN documents d ON d.doc_id = g.vec_id + 1
UNION ALL
SELECT g.case_key, 2, 'FORBIDDEN_CLAIM', b.text, 1
FROM t_gold g JOIN benchmark b ON b.item_id = g.vec_id % (SELECT count(*) FROM benchmark) WHERE g.vec_id % 6 <> 0"""


def assertions(spark: SparkSession, sf: str) -> DataFrame:
    cases, texts = gold(spark, sf), table(spark, sf, "documents").select("doc_id", "text")
    i = F.col("vec_id")

    def row(df: DataFrame, order: int, kind: str, text: F.Column, weight: F.Column) -> DataFrame:
        return df.select(
            "case_key", F.lit(order).alias("sort_order"), F.lit(kind).alias("assertion_type"),
            text.alias("assertion_text"), weight.cast("bigint").alias("weight"),
        )

    line = F.col("text")
    own = cases.join(texts, i == F.col("doc_id"))
    other = cases.join(texts, i + 1 == F.col("doc_id"))
    items = table(spark, sf, "benchmark")
    claims = cases.filter(i % 6 != 0).join(items, i % F.lit(max(1, items.count())) == F.col("item_id"))
    return (
        row(own, 0, "REQUIRED_FACT", line, 1 + i % 3)
        .unionByName(row(other, 1, "REQUIRED_FACT", line, i % 5))
        .unionByName(row(claims, 2, "FORBIDDEN_CLAIM", F.col("text"), F.lit(1)))
    )


CTES["t_answers"] = """
SELECT g.case_key, d.text AS answer, r.cited, r.retrieved, g.vec_id % 3 <> 0 AS claim,
       CASE WHEN g.vec_id % 4 = 0 THEN 'ABSTAIN' ELSE 'INJECT' END AS gate_outcome
FROM t_gold g LEFT JOIN documents d ON d.doc_id = g.vec_id
LEFT JOIN (SELECT case_key,
    list('knowledge:' || document_id || ':v' || version_no || ':' || chunk_id ORDER BY rank) FILTER (rank = 1 OR rank = 2 + query_id % 10) AS cited,
    list('knowledge:' || document_id || ':v' || version_no || ':' || chunk_id ORDER BY rank) FILTER (rank <= 8) AS retrieved
  FROM t_ranked GROUP BY case_key) r ON r.case_key = g.case_key"""


def answer_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of `answers` alone: no list of vectors is made for them."""
    texts = table(spark, sf, "documents").select("doc_id", F.col("text").alias("answer"))
    return gold(spark, sf).join(texts, F.col("vec_id") == F.col("doc_id"), "left").select("case_key", "answer")


def answers(spark: SparkSession, sf: str, ranked: DataFrame | None = None) -> DataFrame:
    i = F.col("vec_id")
    name = F.concat(
        F.lit("knowledge:"), F.col("document_id").cast("string"), F.lit(":v"),
        F.col("version_no").cast("string"), F.lit(":"), F.col("chunk_id").cast("string"),
    )
    ranks = ranked if ranked is not None else ranked_ids(spark, sf)
    lists = ranks.filter("rank <= 12").groupBy("case_key").agg(
        F.collect_list(
            F.when((F.col("rank") == 1) | (F.col("rank") == 2 + F.col("query_id") % 10), name)
        ).alias("cited"),
        F.collect_list(F.when(F.col("rank") <= 8, name)).alias("retrieved"),
    )
    texts = table(spark, sf, "documents").select("doc_id", F.col("text").alias("answer"))
    return (
        gold(spark, sf)
        .join(texts, i == F.col("doc_id"), "left")
        .join(lists, "case_key", "left")
        .select(
            "case_key", "answer", "cited", "retrieved", (i % 3 != 0).alias("claim"),
            F.when(i % 4 == 0, "ABSTAIN").otherwise("INJECT").alias("gate_outcome"),
        )
    )
