"""Ingest, classification, cells, buckets and baselines."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.catalog import inputs as src
from tallyvox.catalog.base import query
from tallyvox.catalog.inputs import CTES, with_tables
from tallyvox.functions import text as tx
from tallyvox.operators import baseline as bl
from tallyvox.operators import buckets as bk
from tallyvox.operators import cells as ce
from tallyvox.operators import classify as cl
from tallyvox.operators import ingest as ig
from tallyvox.operators import topics as tp
from tallyvox.plans.projection import alert_board
from tallyvox.session import checkpoint_dir, stored
from tallyvox.sources import feedback_csv as fc
from tallyvox.sources import rule_tables as rt
from tallyvox.sources import sinks
from tallyvox.sources.reviews import flatten_reviews
from tallyvox.sources.rule_tables import Rule

# --- raw feedback rows out of documents ----------------------------------------------------

_STAMP = "'2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0')"
_CLOCK = "lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || ':05:06'"
CTES["t_raw"] = f"""
SELECT doc_id AS seq, lang AS file, CASE WHEN doc_id % 13 = 0 THEN '  ' ELSE text END AS feedback_text,
       CASE doc_id % 5 WHEN 0 THEN {_STAMP} || 'T' || {_CLOCK} || 'Z'
                       WHEN 1 THEN {_STAMP} || 'T' || {_CLOCK} || '+08:00'
                       WHEN 2 THEN ' ' || {_STAMP} || ' ' || {_CLOCK} || ' '
                       WHEN 3 THEN {_STAMP} || 'T' || {_CLOCK}
                       ELSE {_STAMP} || ' ' || {_CLOCK} END AS occurred_at,
       ' ' || upper(source) || '  App ' AS source, ' ref-' || (doc_id % 700) || ' ' AS external_ref,
       CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'v' || (doc_id % 9) END AS version, doc_id % 4 AS ws
FROM documents"""


def raw_feedback(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + i % 28).cast("string"), 2, "0"))
    clock = F.concat(F.lpad((i % 24).cast("string"), 2, "0"), F.lit(":05:06"))
    iso = F.concat(day, F.lit("T"), clock)
    stamp = (
        F.when(i % 5 == 0, F.concat(iso, F.lit("Z")))
        .when(i % 5 == 1, F.concat(iso, F.lit("+08:00")))
        .when(i % 5 == 2, F.concat(F.lit(" "), day, F.lit(" "), clock, F.lit(" ")))
        .when(i % 5 == 3, iso)
        .otherwise(F.concat(day, F.lit(" "), clock))
    )
    return src.table(spark, sf, "documents").select(
        i.alias("_seq"),
        F.col("lang").alias("_file"),
        F.when(i % 13 == 0, F.lit("  ")).otherwise(F.col("text")).alias("反馈内容"),
        stamp.alias("发生时间"),
        F.concat(F.lit(" "), F.upper("source"), F.lit("  App ")).alias("来源"),
        F.concat(F.lit(" ref-"), (i % 700).cast("string"), F.lit(" ")).alias("工单号"),
        F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), (i % 9).cast("string"))).alias("版本号"),
        (i % 4).alias("_ws"),
    )


MAPPING = fc.ImportMapping("反馈内容", "发生时间", "来源", "工单号", {"version": "版本号"})

_TRIM = r"'^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, {_TRIM})"


def sql_mask(x: str) -> str:
    email = rf"regexp_replace({x}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b', '[EMAIL]', 'g')"
    return rf"regexp_replace({email}, '(^|[^0-9])(?:\+?86[-\s]?)?1[3-9][0-9]{{9}}($|[^0-9])', '\1[PHONE]\2', 'g')"


def sql_normal(x: str) -> str:
    return rf"lower(regexp_replace({sql_trim(x)}, '\s+', ' ', 'g'))"


CTES["t_cleaned"] = f"""
SELECT seq, file, ws, version, error, {sql_trim('source')} AS source_text, masked, when_at AS occurred_at,
       sha256({sql_trim('external_ref')}) AS external_ref_hash,
       substring({sql_normal(sql_mask('source'))}, 1, 64) AS source_kind,
       {sql_normal('masked')} AS normalized_text, sha256({sql_normal('masked')}) AS content_hash
FROM (SELECT *, CASE WHEN {sql_trim('feedback_text')} = '' THEN 'feedback_text 不能为空。'
                     WHEN masked = '' THEN '反馈文本脱敏后为空。'
                     WHEN when_at IS NULL THEN 'occurred_at 必须是 ISO 8601 或 yyyy-MM-dd HH:mm:ss 时间。' END AS error
      FROM (SELECT *, {sql_trim(sql_mask('feedback_text'))} AS masked,
              CASE WHEN occurred_at LIKE '%Z' THEN strptime(occurred_at, '%Y-%m-%dT%H:%M:%SZ')
                   WHEN occurred_at LIKE '%+08:00' THEN strptime(occurred_at, '%Y-%m-%dT%H:%M:%S+08:00') - INTERVAL 8 HOUR
                   WHEN occurred_at LIKE '%T%' THEN NULL
                   ELSE strptime({sql_trim('occurred_at')}, '%Y-%m-%d %H:%M:%S') END AS when_at
            FROM t_raw) a) b"""


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return ig.to_events(fc.apply_mapping(raw_feedback(spark, sf), MAPPING)).withColumnRenamed("_ws", "ws")


@query("csv_scan", "SELECT event_id AS id, user_id % 4 AS ws, event_type AS kind, props AS feedback_text FROM events")
def _(spark, sf):
    target = f"{checkpoint_dir(spark)}/tallyvox_csv/{sf.strip('/').replace('/', '_')}"
    rows = src.feedback(spark, sf).select(
        F.col("event_id").alias("工单号"), F.col("ws").alias("空间"), F.col("event_type").alias("来源"),
        F.col("sanitized_text").alias("反馈内容"),
    )
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(target)
    back = fc.read_feedback_csv(spark, target)
    return back.select(
        F.col("工单号").cast("bigint").alias("id"), F.col("空间").cast("bigint").alias("ws"),
        F.col("来源").alias("kind"), F.col("反馈内容").alias("feedback_text"),
    )


@query("preview", f"SELECT lang, {sql_mask('text')} AS text FROM documents ORDER BY doc_id LIMIT 5")
def _(spark, sf):
    rows = src.table(spark, sf, "documents").orderBy("doc_id").select("lang", "text")
    return fc.preview(rows, 5)


@query("column_mapping", with_tables("""
SELECT seq, feedback_text, occurred_at, source, external_ref,
       CASE WHEN version = '' THEN '' ELSE 'version=' || version END AS dimensions FROM t_raw"""))
def _(spark, sf):
    mapped = fc.apply_mapping(raw_feedback(spark, sf), MAPPING)
    return mapped.withColumnRenamed("_seq", "seq").drop("_file", "_ws")


@query("file_set_scan", """
WITH files AS (SELECT DISTINCT user_id % 10 AS file_id FROM events),
tasks AS (SELECT c_custkey AS task_id, c_custkey % 10 AS file_id,
                 TIMESTAMP '2030-01-01' - to_minutes(CAST(c_custkey AS INTEGER)) AS created_at FROM customer),
newest AS (SELECT task_id FROM (SELECT t.task_id, row_number() OVER (PARTITION BY t.file_id ORDER BY created_at DESC, task_id DESC) AS n
           FROM tasks t JOIN files USING (file_id)) q WHERE n = 1)
SELECT event_id, user_id AS ingested_task_id, ts AS occurred_at FROM events WHERE user_id IN (SELECT task_id FROM newest)""")
def _(spark, sf):
    ev = src.table(spark, sf, "events")
    files = ev.select((F.col("user_id") % 10).alias("file_id")).distinct()
    tasks = src.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("task_id"), (F.col("c_custkey") % 10).alias("file_id"),
        (F.lit("2030-01-01").cast("timestamp") - F.make_dt_interval(mins=F.col("c_custkey").cast("int"))).alias("created_at"),
    )
    events = ev.select("event_id", F.col("user_id").alias("ingested_task_id"), F.col("ts").cast("timestamp").alias("occurred_at"))
    return ig.load_events(files, tasks, events)


@query("review_api_flatten", f"""
SELECT {sql_trim('text')} AS feedback_text, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS occurred_at,
       'review' AS source, CASE WHEN doc_id % 2 = 0 THEN 'moment:' || doc_id ELSE 'm' || doc_id END AS external_ref,
       CAST(doc_id % 5 AS VARCHAR) AS rating, 'review' AS platform, '/review/' || doc_id AS source_url
FROM documents WHERE doc_id BETWEEN 0 AND 744 AND {sql_trim('text')} <> ''""")
def _(spark, sf):
    i = F.col("doc_id")
    even = i % 2 == 0
    record = F.struct(
        F.struct(
            F.concat(F.lit("m"), i.cast("string")).alias("id_str"),
            (F.lit(1704067200) + i * 3600).alias("created_time"),
            F.struct(
                i.cast("string").alias("id"),
                (i % 5).cast("string").alias("score"),
                F.struct(
                    F.when(even, F.col("text")).otherwise(F.lit("")).alias("raw_text"), F.col("text")
                ).alias("contents"),
                F.lit("phone").alias("device"),
            ).alias("review"),
        ).alias("moment"),
        F.when(even, F.concat(F.lit("moment:"), i.cast("string"))).alias("identification"),
    )
    raw = src.table(spark, sf, "documents").select(F.to_json(record).alias("json"))
    stamp = lambda s: F.lit(s).cast("timestamp")
    return flatten_reviews(raw, stamp("2024-01-01"), stamp("2024-02-01"))


@query("pack_binding", """
SELECT n_nationkey::BIGINT AS ws, coalesce(r.r_name, 'ASIA') AS pack_id,
       coalesce(r.r_name || ':v' || r.r_regionkey, (SELECT r_name || ':v' || r_regionkey FROM region WHERE r_name = 'ASIA')) AS pack_version
FROM nation LEFT JOIN region r ON r.r_regionkey = n_regionkey AND n_nationkey % 3 <> 0""")
def _(spark, sf):
    regions = src.table(spark, sf, "region")
    packs = regions.select(
        F.col("r_name").alias("pack_id"),
        F.concat("r_name", F.lit(":v"), F.col("r_regionkey").cast("string")).alias("pack_version"),
    )
    spaces = src.table(spark, sf, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("ws"), F.when(F.col("n_nationkey") % 3 != 0, F.col("r_name")).alias("pack_id")
    )
    return rt.resolve_pack(spaces, packs, "ASIA")


@query("pii_mask", f"SELECT doc_id, {sql_mask('text')} AS masked FROM documents")
def _(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", tx.pii_mask(F.col("text")).alias("masked"))


@query("required_value", with_tables(f"""
SELECT seq, CASE WHEN {sql_trim('feedback_text')} = '' THEN 'feedback_text 不能为空。' END AS error FROM t_raw"""))
def _(spark, sf):
    return raw_feedback(spark, sf).select(
        F.col("_seq").alias("seq"), ig.required(F.col("反馈内容"), "feedback_text").alias("error")
    )


@query("parse_occurred_at", with_tables("SELECT seq, occurred_at FROM t_cleaned"))
def _(spark, sf):
    return raw_feedback(spark, sf).select(
        F.col("_seq").alias("seq"), tx.parse_occurred_at(F.col("发生时间")).alias("occurred_at")
    )


@query("import_normalize", f"SELECT doc_id, {sql_normal('text')} AS normalized FROM documents")
def _(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", tx.import_normalize(F.col("text")).alias("normalized"))


@query("source_kind", with_tables("SELECT seq, source_kind FROM t_cleaned"))
def _(spark, sf):
    return raw_feedback(spark, sf).select(F.col("_seq").alias("seq"), tx.source_kind(F.col("来源")).alias("source_kind"))


@query("hashes", with_tables("SELECT seq, external_ref_hash, content_hash FROM t_cleaned"))
def _(spark, sf):
    return cleaned(spark, sf).select(F.col("_seq").alias("seq"), "external_ref_hash", "content_hash")


@query("blank_after_mask", with_tables("""
SELECT seq, 'good' AS side FROM t_cleaned WHERE masked <> '' UNION ALL SELECT seq, 'bad' FROM t_cleaned WHERE masked = ''"""))
def _(spark, sf):
    good, bad = ig.drop_blank(cleaned(spark, sf), "sanitized_text")
    side = lambda df, name: df.select(F.col("_seq").alias("seq"), F.lit(name).alias("side"))
    return side(good, "good").unionByName(side(bad, "bad"))


CTES["t_outcomes"] = """
SELECT seq, file, error, CASE WHEN error IS NOT NULL THEN 'failed'
         WHEN row_number() OVER (PARTITION BY ws, external_ref_hash, error IS NULL ORDER BY seq) = 1
          AND external_ref_hash NOT IN (SELECT sha256('ref-' || o_orderkey) FROM orders WHERE o_orderstatus = 'F') THEN 'imported'
         ELSE 'duplicate' END AS outcome FROM t_cleaned"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaned(spark, sf).withColumn("source_id", F.lit(1))
    known = src.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("ws"),
        F.lit(1).alias("source_id"),
        F.sha2(F.concat(F.lit("ref-"), F.col("o_orderkey").cast("string")), 256).alias("external_ref_hash"),
    )
    return ig.dedupe_insert(rows, known)


@query("dedupe_insert", with_tables("SELECT seq, outcome FROM t_outcomes"))
def _(spark, sf):
    return outcomes(spark, sf).select(F.col("_seq").alias("seq"), "outcome")


@query("error_report", with_tables("""
SELECT file, count(*) FILTER (outcome = 'imported') AS imported, count(*) FILTER (outcome = 'duplicate') AS duplicates,
       count(*) FILTER (outcome = 'failed') AS failed,
       coalesce(string_agg(CASE WHEN outcome = 'failed' AND n <= 10 THEN '第 ' || (seq + 2) || ' 行：' || error END, '|' ORDER BY seq), '') AS errors
FROM (SELECT *, row_number() OVER (PARTITION BY file, outcome ORDER BY seq) AS n FROM t_outcomes) q GROUP BY file"""))
def _(spark, sf):
    return ig.import_report(outcomes(spark, sf).withColumn("row_no", F.col("_seq") + 1))


def page_files(spark, sf):
    """A folder with a file per page, some empty and some with names that are no CSV file's."""
    folder = f"{checkpoint_dir(spark)}/tallyvox_files/{uuid.uuid4().hex}"
    storage, path = pafs.FileSystem.from_uri(folder)
    storage.create_dir(path, recursive=True)

    def write(batches):
        out, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with out.open_output_stream(f"{root}/{name}", compression=None) as file:
                    file.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    i = F.col("page_id")
    name = F.concat(F.lit("page-"), i.cast("string"), F.when(i % 5 == 0, ".CSV").when(i % 7 == 0, ".txt").otherwise(".csv"))
    content = F.when(i % 11 == 0, F.lit("")).otherwise(F.coalesce("html", F.lit(""))).cast("binary")
    src.table(spark, sf, "pages").select(name.alias("name"), content.alias("content")).mapInArrow(write, "name string").count()
    return folder


@query("file_manifest", """
SELECT name, octet_length(content) AS size, sha256(content) AS sha256, octet_length(content) > 0 AND lower(name) LIKE '%.csv' AS valid FROM (
  SELECT 'page-' || page_id || CASE WHEN page_id % 5 = 0 THEN '.CSV' WHEN page_id % 7 = 0 THEN '.txt' ELSE '.csv' END AS name,
         encode(CASE WHEN page_id % 11 = 0 THEN '' ELSE coalesce(html, '') END) AS content FROM pages) q""")
def _(spark, sf):
    return fc.file_manifest(spark, page_files(spark, sf))


@query("fact_overwrite", with_tables("""
SELECT ws, canonical_key, bucket_start, feedback_count, NULL AS links FROM t_buckets WHERE ws <> 3
UNION ALL SELECT ws, canonical_key, NULL, NULL, sum(feedback_count) FROM t_buckets WHERE ws NOT IN (2, 3) GROUP BY ALL"""))
def _(spark, sf):
    """Two fact tables: all workspaces, then 2 and 3 again, of which only one table has rows of 2 and none of 3."""
    folder = f"{checkpoint_dir(spark)}/tallyvox_facts/{uuid.uuid4().hex}"
    counts = src.buckets(spark, sf).drop("source_counts")
    topics = counts.groupBy("ws", "canonical_key").agg(F.sum("feedback_count").alias("links"))
    sinks.commit_facts(spark, folder, {"counts": counts, "topics": topics}, counts.select("ws"))
    again = spark.createDataFrame([(2,), (3,)], "ws long")
    sinks.commit_facts(spark, folder, {"counts": counts.where("ws = 2"), "topics": topics.limit(0)}, again)
    both = sinks.read_facts(spark, folder, "counts").unionByName(sinks.read_facts(spark, folder, "topics"), allowMissingColumns=True)
    return both.select("ws", "canonical_key", "bucket_start", "feedback_count", "links")


# --- classification ------------------------------------------------------------------------

SYNONYMS = [(["tion", "sion"], "xion"), (["heit", "keit"], "hxt"), (["xion the"], "xthe")]
TOPICS = [
    Rule("topic_matchmaking", "Matching", 90, ["hein", "ereau", "eauou", "hein"], [], []),
    Rule("topic_gameplay", "Play", 80, ["tion", "der", "que"], ["en"], ["pf"]),
    Rule("topic_network", "Network", 80, ["the", "ung"], [], []),
    Rule("network", "Net", 70, ["est", "und", "oir"], [], ["xz"]),
    Rule("graphics", "Graphics", 60, ["eur", "ment", "ado"], ["e", "a"], []),
]
EXPRESSIONS = [
    Rule("expr_suggestion", "Suggest", 40, ["should", "eron", "eaux"]),
    Rule("expr_complaint", "Complaint", 30, ["bad", "heit", "ithe", "ción"], [], ["qu"]),
    Rule("expr_praise", "Praise", 30, ["good", "ich", "ness", "est"]),
    Rule("expr_neutral", "Neutral", 10, ["on"]),
]
LEXICON = cl.Lexicon(
    topic_words=[(["network"], ["est", "und"]), (["graphics"], ["ment", "ado"])],
    positive=["and", "ie", "la"],
    negative=["nt", "sch", "do"],
    contrast_long="on t",
    contrast_short="on",
)
_SEPARATORS = (
    r"'[\t-\r\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}"
    r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x{3001}-\x{303F}]+', ' ', 'g'"
)


def sql_analysis(x: str, synonyms: list) -> str:
    wide, narrow = tx._full_width()
    out = f"translate({x}, '{wide}', '{narrow.replace(chr(39), chr(39) * 2)}')"
    out = f"translate({out}, '{tx.TRADITIONAL}', '{tx.SIMPLIFIED}')"
    out = f"lower({sql_trim(f'regexp_replace({out}, {_SEPARATORS})')})"
    for variants, target in synonyms:
        for v in variants:
            out = f"replace({out}, '{v}', '{target}')"
    return out


CTES["t_texts"] = f"SELECT doc_id AS event_id, {sql_analysis('text', SYNONYMS)} AS normalized_text FROM documents"


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "documents").select(
        F.col("doc_id").alias("event_id"),
        tx.analysis_normalize(F.col("text"), SYNONYMS).alias("normalized_text"),
        (F.col("doc_id") % 4).alias("ws"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("occurred_at"),
    )


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join([f"contains({x}, '{w}')" for w in words] or ["false"]) + ")"


def _all(x: str, words: list[str]) -> str:
    return "(" + " AND ".join([f"contains({x}, '{w}')" for w in words] or ["true"]) + ")"


def sql_candidates(x: str, rules: list[Rule]) -> str:
    rows = []
    for i, r in enumerate(rules):
        hits = " + ".join(f"contains({x}, '{w}')::INT" for w in r.any_patterns)
        longest = "greatest(" + ", ".join(f"CASE WHEN contains({x}, '{w}') THEN {len(w)} ELSE 0 END" for w in r.any_patterns) + ", 0)"
        rows.append(
            f"CASE WHEN NOT {_any(x, r.exclude_patterns)} AND {_any(x, r.any_patterns)} AND {_all(x, r.all_patterns)} "
            f"THEN {{'p': {-r.priority}, 'h': {hits}, 'l': -{longest}, 'i': {i}, 'k': '{r.canonical_key}'}} END"
        )
    return f"list_sort(list_filter([{', '.join(rows)}], lambda c: c IS NOT NULL))"


CTES["t_candidates"] = f"SELECT event_id, normalized_text, {sql_candidates('normalized_text', TOPICS)} AS c FROM t_texts"
_TIED = "(len(c) > 1 AND c[1].p = c[2].p AND c[1].h = c[2].h)"
CTES["t_labels"] = f"""
SELECT event_id, c[1].k AS canonical_key, 1.0 AS confidence, 'rule' AS method, 1 AS rank FROM t_candidates WHERE len(c) > 0
UNION ALL
SELECT event_id, c[2].k, CASE WHEN {_TIED} THEN 0.5 ELSE 1.0 END, CASE WHEN {_TIED} THEN 'ambiguous' ELSE 'rule' END, 2
FROM t_candidates WHERE len(c) > 1"""
CTES["t_reasons"] = f"""
SELECT event_id, CASE WHEN {_TIED} THEN 'ambiguous_topics' WHEN len(c) > 2 THEN 'too_many_topics' END AS reason FROM t_candidates"""
CTES["t_expressions"] = f"""
SELECT event_id, CASE WHEN len(c) = 0 THEN 'expr_other' ELSE c[1].k END AS expression,
       CASE WHEN {_TIED} THEN 0.5 ELSE 1.0 END AS confidence, {_TIED} AS mixed
FROM (SELECT event_id, {sql_candidates('normalized_text', EXPRESSIONS)} AS c FROM t_texts) q"""


def labels(spark, sf):
    return cl.topic_classify(texts(spark, sf), TOPICS)


def classified(spark, sf):
    return cl.classify_events(texts(spark, sf), TOPICS, EXPRESSIONS, LEXICON)


@query("analysis_normalize", with_tables("SELECT event_id, normalized_text FROM t_texts"))
def _(spark, sf):
    return texts(spark, sf).select("event_id", "normalized_text")


@query("token_estimate", """
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 1 ELSE CAST(floor(cjk / 1.5 + (units - cjk) / 4.0) AS BIGINT) + 1 END AS tokens
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[一-鿿]')) AS cjk,
             length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS units FROM documents) q""")
def _(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


_WORDS = ["tion", "the", "der", "tion", "eaux", "zz"]


@query("pattern_hits", with_tables(f"""
SELECT event_id, {' + '.join(f"contains(normalized_text, '{w}')::BIGINT" for w in _WORDS)} AS hits,
       greatest({', '.join(f"CASE WHEN contains(normalized_text, '{w}') THEN {len(w)} ELSE 0 END" for w in _WORDS)})::BIGINT AS longest
FROM t_texts"""))
def _(spark, sf):
    return texts(spark, sf).select("event_id", tx.pattern_hits(F.col("normalized_text"), _WORDS).alias("p")).select(
        "event_id", "p.hits", "p.longest"
    )


@query("topic_classify", with_tables("SELECT event_id, canonical_key, confidence::DOUBLE AS confidence, method, rank::BIGINT AS rank FROM t_labels"))
def _(spark, sf):
    return labels(spark, sf)


@query("review_reason", with_tables("SELECT event_id, reason FROM t_reasons"))
def _(spark, sf):
    return cl.review_reason(texts(spark, sf), TOPICS)


CTES["t_general"] = """
SELECT event_id, canonical_key, confidence, method, rank FROM t_labels
UNION ALL SELECT event_id, 'topic_general', 1.0, 'general', 1 FROM t_candidates WHERE len(c) = 0"""


@query("general_fallback", with_tables("SELECT event_id, canonical_key, confidence::DOUBLE AS confidence, method, rank::BIGINT AS rank FROM t_general"))
def _(spark, sf):
    return cl.classified_links(classified(spark, sf)).drop("ws", "occurred_at", "sentiment")


@query("model_label_merge", with_tables("""
WITH attempts AS (
  SELECT t.event_id, CASE l.quality WHEN 1 THEN 'network' ELSE 'topic_general' END AS scored_key,
         0.5 + (t.event_id % 50) / 100.0 AS conf,
         e.expression IN ('expr_complaint', 'expr_suggestion') AND length(t.normalized_text) >= 15 AND l.doc_id IS NOT NULL AS asked
  FROM t_candidates t LEFT JOIN t_expressions e USING (event_id) LEFT JOIN labels l ON l.doc_id = t.event_id WHERE len(t.c) = 0),
judged AS (SELECT *, CASE WHEN asked THEN conf >= 0.7 AND scored_key <> 'topic_general' END AS accepted FROM attempts)
SELECT event_id, canonical_key, confidence::DOUBLE AS confidence, method, rank::BIGINT AS rank, NULL::BOOLEAN AS accepted FROM t_labels
UNION ALL
SELECT event_id, CASE WHEN accepted THEN scored_key ELSE 'topic_general' END,
       round((CASE WHEN accepted THEN conf ELSE 1.0 END)::DOUBLE, 6), CASE WHEN accepted THEN 'llm' ELSE 'general' END, 1, accepted FROM judged"""))
def _(spark, sf):
    scored = src.table(spark, sf, "labels").select(
        F.col("doc_id").alias("event_id"),
        F.when(F.col("quality") == 1, "network").otherwise("topic_general").alias("scored_key"),
        (F.lit(0.5) + (F.col("doc_id") % 50) / 100.0).alias("scored_confidence"),
    )
    rows = stored(texts(spark, sf))  # read three times
    return cl.model_label_merge(
        rows, cl.topic_classify(rows, TOPICS), cl.expression_classify(rows, EXPRESSIONS), scored, [r.canonical_key for r in TOPICS]
    )


@query("expression_classify", with_tables("SELECT event_id, expression, confidence::DOUBLE AS confidence, mixed FROM t_expressions"))
def _(spark, sf):
    return cl.expression_classify(texts(spark, sf), EXPRESSIONS)


def _sql_window(key: str, words: list[str]) -> str:
    x, short, long = "normalized_text", LEXICON.contrast_short, LEXICON.contrast_long
    index = "list_min(list_filter([" + ", ".join(f"instr({x}, '{w}') - 1" for w in words) + "], lambda p: p >= 0))"
    return f"""
SELECT event_id, canonical_key, {x} AS t, {index} AS i FROM t_labels JOIN t_texts USING (event_id) WHERE canonical_key = '{key}'"""


CTES["t_sentiments"] = f"""
WITH located AS ({' UNION ALL '.join(_sql_window(keys[0], words) for keys, words in LEXICON.topic_words)}),
edges AS (SELECT *, length(substring(t, 1, i + 2)) - instr(reverse(substring(t, 1, i + 2)), 'no') - 1 AS prev,
                 instr(reverse(substring(t, 1, i + 2)), 'no') > 0 AS has_prev,
                 instr(substring(t, i + 1), 'on') - 1 AS nxt FROM located WHERE i IS NOT NULL),
cut AS (SELECT event_id, canonical_key, t,
  CASE WHEN has_prev THEN greatest(greatest(0, i - 12), prev + CASE WHEN substring(t, prev + 1, 4) = 'on t' THEN 4 ELSE 2 END) ELSE greatest(0, i - 12) END AS s,
  CASE WHEN nxt >= 0 THEN least(least(length(t), i + 16), i + nxt) ELSE least(length(t), i + 16) END AS e FROM edges),
windows AS (SELECT event_id, canonical_key, substring(t, s + 1, e - s) AS w FROM cut
  UNION ALL SELECT event_id, canonical_key, t FROM located WHERE i IS NULL
  UNION ALL SELECT event_id, canonical_key, normalized_text FROM t_labels JOIN t_texts USING (event_id) WHERE canonical_key NOT IN ('network', 'graphics'))
SELECT event_id, canonical_key, CASE WHEN {_any('w', LEXICON.positive)} AND {_any('w', LEXICON.negative)} THEN 'mixed'
  WHEN {_any('w', LEXICON.positive)} THEN 'positive' WHEN {_any('w', LEXICON.negative)} THEN 'negative' ELSE 'neutral' END AS sentiment FROM windows"""


@query("topic_sentiment", with_tables("SELECT event_id, canonical_key, sentiment FROM t_sentiments"))
def _(spark, sf):
    rows = stored(texts(spark, sf))  # read twice
    return cl.topic_sentiment(rows, cl.topic_classify(rows, TOPICS), LEXICON)


CTES["t_full_links"] = """
SELECT g.event_id, g.canonical_key, g.rank, g.method, g.confidence, coalesce(s.sentiment, w.whole, 'neutral') AS sentiment
FROM t_general g LEFT JOIN t_sentiments s USING (event_id, canonical_key)
LEFT JOIN (SELECT event_id, CASE WHEN {pos} AND {neg} THEN 'mixed' WHEN {pos} THEN 'positive' WHEN {neg} THEN 'negative' ELSE 'neutral' END AS whole
           FROM t_texts WHERE trim(normalized_text) <> '') w ON w.event_id = g.event_id AND g.method = 'general'""".format(
    pos=_any("normalized_text", LEXICON.positive), neg=_any("normalized_text", LEXICON.negative)
)


def full_links(spark, sf):
    return cl.classified_links(classified(spark, sf)).drop("ws", "occurred_at")


@query("issue_links", with_tables("SELECT event_id, canonical_key, rank::BIGINT AS rank, method, confidence::DOUBLE AS confidence, sentiment FROM t_full_links"))
def _(spark, sf):
    return full_links(spark, sf)


CTES["t_review"] = """
SELECT event_id, reason_code, suggested_key, suggested_sentiment FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id, reason_code ORDER BY o, suggested_key) AS n FROM (
    SELECT r.event_id, r.reason AS reason_code, l.canonical_key AS suggested_key, l.sentiment AS suggested_sentiment, 0 AS o
    FROM t_reasons r LEFT JOIN t_full_links l ON l.event_id = r.event_id AND l.rank = 1 WHERE r.reason IS NOT NULL
    UNION ALL
    SELECT event_id, CASE WHEN sentiment = 'mixed' THEN 'mixed_sentiment' ELSE 'ambiguous_topics' END, canonical_key, sentiment, rank
    FROM t_full_links WHERE sentiment = 'mixed' OR method = 'ambiguous') u) q WHERE n = 1"""


def review_rows(spark, sf):
    return cl.classified_reviews(classified(spark, sf))


@query("review_candidates", with_tables("SELECT event_id, reason_code, suggested_key, suggested_sentiment FROM t_review"))
def _(spark, sf):
    return review_rows(spark, sf)


@query("annotations", with_tables("""
SELECT event_id % 4 AS ws, event_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(event_id AS INTEGER)) AS occurred_at, expression,
       confidence::DOUBLE AS confidence, mixed, 'platform:expression:v1' AS rule_version, 'default:v2' AS pack_version FROM t_expressions"""))
def _(spark, sf):
    rows = texts(spark, sf)
    return cl.annotations(rows, cl.expression_classify(rows, EXPRESSIONS))


@query("pending_review_list", with_tables("""
SELECT r.event_id, r.reason_code, r.suggested_key, coalesce(d.text, '样本不可用') AS sample_text
FROM t_review r LEFT JOIN (SELECT * FROM documents WHERE lang <> 'es') d ON d.doc_id = r.event_id
WHERE r.reason_code = 'mixed_sentiment' AND r.event_id % 2 = 0"""))
def _(spark, sf):
    rows = review_rows(spark, sf).withColumn(
        "status", F.when(F.col("event_id") % 2 == 0, "pending").otherwise("confirmed")
    )
    known = src.table(spark, sf, "documents").filter("lang <> 'es'").select(
        F.col("doc_id").alias("event_id"), F.col("text").alias("sanitized_text")
    )
    return tp.pending_reviews(rows, known, "mixed_sentiment").select(
        "event_id", "reason_code", "suggested_key", "sample_text"
    )


@query("catalog_upsert", with_tables("""
WITH old AS (SELECT ws, canonical_key, 'old ' || canonical_key AS canonical_name, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen
             FROM t_links WHERE occurred_at < TIMESTAMP '2024-01-10' AND canonical_key <> 'view' GROUP BY ws, canonical_key),
fresh AS (SELECT ws, canonical_key, min(occurred_at) AS f, max(occurred_at) AS l FROM t_links WHERE occurred_at >= TIMESTAMP '2024-01-08' GROUP BY ws, canonical_key)
SELECT ws, canonical_key, coalesce(canonical_name, CASE WHEN canonical_key <> 'click' THEN upper(canonical_key) END, canonical_key) AS canonical_name,
       least(first_seen, f) AS first_seen, greatest(last_seen, l) AS last_seen
FROM old FULL JOIN fresh USING (ws, canonical_key)"""))
def _(spark, sf):
    rows = src.links(spark, sf)
    old = rows.filter("occurred_at < '2024-01-10' AND canonical_key <> 'view'").groupBy("ws", "canonical_key").agg(
        F.concat(F.lit("old "), "canonical_key").alias("canonical_name"),
        F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"),
    )
    names = rows.select("canonical_key").distinct().filter("canonical_key <> 'click'").withColumn("name", F.upper("canonical_key"))
    return tp.catalog_upsert(old, rows.filter("occurred_at >= '2024-01-08'"), names)


@query("alias_upsert", with_tables("""
SELECT ws, canonical_name AS normalized_alias, canonical_key FROM t_catalog WHERE NOT (ws = 1 AND canonical_name IN ('VIEW', 'CLICK'))"""))
def _(spark, sf):
    known = src.topic_catalog(spark, sf)
    existing = known.filter("ws = 1 AND canonical_name IN ('VIEW', 'CLICK')").select(
        "ws", F.col("canonical_name").alias("normalized_alias")
    )
    return tp.alias_upsert(existing, known).select("ws", "normalized_alias", "canonical_key")


@query("completeness_check", with_tables("""
WITH e AS (SELECT ws, count(*) AS n_events FROM t_events GROUP BY ws),
c AS (SELECT ws, count(*) AS n_cells FROM t_cells WHERE ws <> 1 GROUP BY ws),
a AS (SELECT ws, count(*) AS n_annotations FROM t_annotations WHERE ws <> 2 GROUP BY ws)
SELECT ws, n_events, coalesce(n_cells, 0) AS n_cells, coalesce(n_annotations, 0) AS n_annotations,
       n_events > 0 AND NOT (coalesce(n_cells, 0) > 0 AND coalesce(n_annotations, 0) > 0) AS needs_rebuild
FROM e LEFT JOIN c USING (ws) LEFT JOIN a USING (ws)"""))
def _(spark, sf):
    return tp.completeness_check(
        src.feedback(spark, sf), src.cells(spark, sf).filter("ws <> 1"), src.annotations(spark, sf).filter("ws <> 2")
    )


# --- cells, buckets, baselines -------------------------------------------------------------

# The sequential rule written as a walk over row numbers, all workspaces in step.
CTES["t_walk"] = """
SELECT ws, event_id, occurred_at, CAST(floor((length(sanitized_text)) / 4.0) AS BIGINT) + 1 AS tokens,
       row_number() OVER (PARTITION BY ws ORDER BY occurred_at, event_id) AS rn FROM t_events"""
CTES["t_numbered"] = """
SELECT ws, rn, event_id, occurred_at, tokens, 1::BIGINT AS cell_no, occurred_at AS started, 1::BIGINT AS held, tokens AS used
FROM t_walk WHERE rn = 1
UNION ALL
SELECT w.ws, w.rn, w.event_id, w.occurred_at, w.tokens,
       n.cell_no + (n.held >= 40 OR epoch_us(w.occurred_at) - epoch_us(n.started) >= 3600000000 OR n.used + w.tokens > 6000)::BIGINT,
       CASE WHEN n.held >= 40 OR epoch_us(w.occurred_at) - epoch_us(n.started) >= 3600000000 OR n.used + w.tokens > 6000 THEN w.occurred_at ELSE n.started END,
       CASE WHEN n.held >= 40 OR epoch_us(w.occurred_at) - epoch_us(n.started) >= 3600000000 OR n.used + w.tokens > 6000 THEN 1 ELSE n.held + 1 END,
       CASE WHEN n.held >= 40 OR epoch_us(w.occurred_at) - epoch_us(n.started) >= 3600000000 OR n.used + w.tokens > 6000 THEN w.tokens ELSE n.used + w.tokens END
FROM t_numbered n JOIN t_walk w ON w.ws = n.ws AND w.rn = n.rn + 1"""
_CELL_SQL = """
SELECT ws, cell_no, event_id, min(occurred_at) OVER c AS window_start, max(occurred_at) OVER c AS window_end,
       CASE WHEN next_start IS NULL THEN 'stream_end' WHEN count(*) OVER c >= 40 THEN 'count_limit'
            WHEN epoch_us(next_start) - epoch_us(min(occurred_at) OVER c) >= 3600000000 THEN 'window_limit' ELSE 'token_limit' END AS close_reason,
       count(*) OVER c AS event_count, CAST(sum(tokens) OVER c AS BIGINT) AS estimated_tokens
FROM (SELECT n.*, f.s AS next_start FROM t_numbered n
      LEFT JOIN (SELECT ws, cell_no - 1 AS cell_no, min(occurred_at) AS s FROM t_numbered GROUP BY ws, cell_no) f
      ON f.ws = n.ws AND f.cell_no = n.cell_no) q
WINDOW c AS (PARTITION BY ws, cell_no)"""


@query("data_cell", with_tables(_CELL_SQL, recursive=True))
def _(spark, sf):
    return ce.data_cells(src.feedback(spark, sf)).select(
        "ws", "cell_no", "event_id", "window_start", "window_end", "close_reason", "event_count", "estimated_tokens"
    )


@query("issue_daily_bucket", with_tables("""
WITH s AS (SELECT ws, canonical_key, date_trunc('day', occurred_at)::TIMESTAMP AS bucket_start, source_kind, count(*) AS n FROM t_links GROUP BY ALL)
SELECT ws, canonical_key, bucket_start, CAST(sum(n) AS BIGINT) AS feedback_count, string_agg(source_kind || '=' || n, '|' ORDER BY source_kind) AS source_counts
FROM s GROUP BY ws, canonical_key, bucket_start"""))
def _(spark, sf):
    return bk.issue_daily_buckets(src.feedback(spark, sf), src.links(spark, sf).select("event_id", "canonical_key"))


@query("bucket_merge", with_tables("""
WITH b AS (SELECT *, value % 2 = 0 AS x FROM (SELECT l.*, e.k AS value FROM t_links l JOIN t_events e USING (event_id)) q),
s AS (SELECT ws, canonical_key, date_trunc('day', occurred_at)::TIMESTAMP AS bucket_start, source_kind, count(*) AS n FROM b GROUP BY ALL)
SELECT ws, canonical_key, bucket_start, CAST(sum(n) AS BIGINT) AS feedback_count, string_agg(source_kind || '=' || n, '|' ORDER BY source_kind) AS source_counts
FROM s GROUP BY ws, canonical_key, bucket_start"""))
def _(spark, sf):
    rows = src.links(spark, sf)
    old = F.col("event_id") % 2 == 0
    return bk.bucket_merge(bk.bucket_counts(rows.filter(old)), bk.bucket_counts(rows.filter(~old)))


@query("expression_daily_bucket", with_tables("""
SELECT ws, expression, date_trunc('day', occurred_at)::TIMESTAMP AS bucket_start, count(*) AS feedback_count FROM t_annotations GROUP BY ALL"""))
def _(spark, sf):
    return bk.expression_daily_buckets(src.annotations(spark, sf))


@query("cell_issue", with_tables("""
SELECT ws, cell_no, canonical_key, mention_count, array_to_string(sample_event_ids, '|') AS sample_event_ids FROM t_cell_issues"""))
def _(spark, sf):
    return src.issues_of_cells(spark, sf)


@query("source_window", with_tables("SELECT ws, min(window_start) AS window_start, max(window_end) AS window_end FROM t_cells GROUP BY ws"))
def _(spark, sf):
    return ce.source_window(src.cells(spark, sf))


# The fold over days as a recursion over row numbers.
CTES["t_days"] = """
SELECT *, row_number() OVER (PARTITION BY ws, canonical_key ORDER BY bucket_start) AS rn FROM t_buckets"""
CTES["t_fold"] = """
SELECT ws, canonical_key, bucket_start, feedback_count, rn, 0::BIGINT AS prior_active, 0.0::DOUBLE AS prior_ewma, 0.0::DOUBLE AS prior_variance,
       1::BIGINT AS active_buckets, feedback_count::DOUBLE AS ewma, 0.0::DOUBLE AS variance FROM t_days WHERE rn = 1
UNION ALL
SELECT d.ws, d.canonical_key, d.bucket_start, d.feedback_count, d.rn, f.active_buckets, f.ewma, f.variance, f.active_buckets + 1,
       f.ewma + 0.3::DOUBLE * (d.feedback_count - f.ewma),
       0.7::DOUBLE * (f.variance + 0.3::DOUBLE * (d.feedback_count - f.ewma) * (d.feedback_count - f.ewma))
FROM t_fold f JOIN t_days d ON d.ws = f.ws AND d.canonical_key = f.canonical_key AND d.rn = f.rn + 1"""
CTES["t_classed"] = """
SELECT *, CASE WHEN prior_active < 3 THEN CASE WHEN feedback_count >= 5 THEN 'surge' WHEN feedback_count <= 2 THEN 'longtail' ELSE 'normal' END
            WHEN prior_ewma >= 5 AND z < 2 THEN 'chronic'
            WHEN z >= 2 AND feedback_count >= 5 THEN CASE WHEN prior_ewma >= 5 THEN 'escalating' ELSE 'surge' END
            WHEN feedback_count <= 2 AND prior_ewma < 5 THEN 'longtail' ELSE 'normal' END AS classification
FROM (SELECT *, (feedback_count - prior_ewma) / greatest(sqrt(prior_variance), 1.0) AS z FROM t_fold) q"""


def _detect_sql(against: str) -> str:
    ewma = "ewma" if against == "post" else "CASE WHEN prior_active = 0 THEN ewma ELSE prior_ewma END"
    std = "sqrt(variance)" if against == "post" else "CASE WHEN prior_active = 0 THEN sqrt(variance) ELSE sqrt(prior_variance) END"
    return f"""
SELECT *, (feedback_count - be) / greatest(bs, 1.0) AS z_score, greatest(10, CAST(floor(be + 2 * bs + 0.5) AS BIGINT)) AS effective_threshold,
       feedback_count >= greatest(10, CAST(floor(be + 2 * bs + 0.5) AS BIGINT)) AS fires
FROM (SELECT *, {ewma} AS be, {std} AS bs FROM t_classed) q"""


CTES["t_post"] = _detect_sql("post")
CTES["t_prior"] = _detect_sql("prior")


def states(spark, sf):
    return bl.ewma_baseline(src.buckets(spark, sf))


_STATE_SQL = """ws, canonical_key, bucket_start, feedback_count, active_buckets, round(ewma, 6) AS ewma, round(variance, 6) AS variance"""


@query("ewma_baseline", with_tables(f"""
SELECT {_STATE_SQL}, round(sqrt(variance), 6) AS std, CASE WHEN active_buckets >= 3 THEN 'active' ELSE 'baseline_building' END AS status FROM t_fold""", recursive=True))
def _(spark, sf):
    return states(spark, sf).select(
        "ws", "canonical_key", "bucket_start", "feedback_count", "active_buckets", "ewma", "variance", "std", "status"
    )


@query("issue_class", with_tables("SELECT ws, canonical_key, bucket_start, classification FROM t_classed", recursive=True))
def _(spark, sf):
    return bl.issue_class(states(spark, sf)).select("ws", "canonical_key", "bucket_start", "classification")


_ALERT_COLUMNS = ["ws", "canonical_key", "bucket_start", "z_score", "effective_threshold", "fires"]


@query("alert_detect", with_tables(
    "SELECT ws, canonical_key, bucket_start, round(z_score, 6) AS z_score, effective_threshold, fires FROM t_post", recursive=True))
def _(spark, sf):
    return bl.alert_detect(states(spark, sf)).select(*_ALERT_COLUMNS)


@query("alert_detect_prior", with_tables(
    "SELECT ws, canonical_key, bucket_start, round(z_score, 6) AS z_score, effective_threshold, fires FROM t_prior", recursive=True))
def _(spark, sf):
    return bl.alert_detect(states(spark, sf), against="prior").select(*_ALERT_COLUMNS)


@query("alert_cooldown", with_tables("""
SELECT ws, canonical_key, min(bucket_start) AS bucket_start FROM t_prior WHERE fires GROUP BY ws, canonical_key""", recursive=True))
def _(spark, sf):
    fired = bl.alert_detect(states(spark, sf), against="prior")
    return bl.alert_cooldown(fired).select("ws", "canonical_key", "bucket_start")


@query("alert_evidence", with_tables("""
SELECT ws, canonical_key, bucket_start, strftime(bucket_start, '%Y-%m-%dT%H:%MZ') AS e_bucket, feedback_count AS e_count,
       effective_threshold AS e_threshold, active_buckets AS e_active, classification AS e_class, round(be, 6) AS e_ewma
FROM t_prior WHERE fires""", recursive=True))
def _(spark, sf):
    fired = bl.alert_detect(bl.issue_class(states(spark, sf)), against="prior").filter("fires")
    read = lambda name, kind: F.get_json_object("evidence_json", f"$.{name}").cast(kind)
    return bl.alert_evidence(fired).select(
        "ws", "canonical_key", "bucket_start",
        read("bucket_start", "string").alias("e_bucket"), read("current_count", "bigint").alias("e_count"),
        read("effective_threshold", "bigint").alias("e_threshold"), read("active_buckets", "bigint").alias("e_active"),
        read("classification", "string").alias("e_class"), read("baseline_ewma", "double").alias("e_ewma"),
    )


_BOARD_SQL = """
SELECT ws, canonical_key, bucket_start, feedback_count, active_buckets, round(be, 6) AS baseline_ewma, round(bs, 6) AS baseline_std,
       classification, round(z_score, 6) AS z_score, effective_threshold, fires, s AS risk_score,
       CASE WHEN s >= 80 THEN 'P0' WHEN s >= 60 THEN 'P1' WHEN s >= 40 THEN 'P2' ELSE 'P3' END AS risk_level
FROM (SELECT *, least(40, greatest(0, CAST(floor(z_score * 5 + 0.5) AS BIGINT))) + least(25, feedback_count)
             + CASE WHEN canonical_key LIKE '%payment%' THEN 20 ELSE 5 END AS s FROM t_prior) q"""


@query("alert_board", with_tables(_BOARD_SQL, recursive=True))
def board(spark, sf):
    return alert_board(src.feedback(spark, sf), src.links(spark, sf).select("event_id", "canonical_key"))
