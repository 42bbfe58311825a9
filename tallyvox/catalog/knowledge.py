"""Corpus and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvox.catalog import inputs as src
from tallyvox.catalog.base import query
from tallyvox.catalog.inputs import AS_OF, CTES, chunk_sql, with_tables
from tallyvox.functions import questions as qs
from tallyvox.functions import text as tx
from tallyvox.operators import corpus as co
from tallyvox.operators import retrieval as rt
from tallyvox.operators import search as se
from tallyvox.operators import selection as sl
from tallyvox.plans.evidence import retrieve
from tallyvox.session import materialize, small_side, stored
from tallyvox.sources import sinks

# --- corpus --------------------------------------------------------------------------------


@query("chunk_documents", with_tables("""
SELECT document_id, chunk_no, content, section_heading, greatest(1, length(content)) AS token_count FROM t_pieces"""))
def _(spark, sf):
    docs = src.table(spark, sf, "documents").withColumnRenamed("doc_id", "document_id")
    return co.chunk_documents(docs)


_HTML = r"regexp_replace(html, '(?is)<(script|style|head)\b.*?</(script|style|head)>', '', 'g')"
_HTML_SQL = rf"""SELECT page_id, regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace({_HTML}, '(?is)<h1\b[^>]*>(.*?)</h1>', chr(10) || '# \1' || chr(10), 'g'),
  '(?is)<h2\b[^>]*>(.*?)</h2>', chr(10) || '## \1' || chr(10), 'g'), '(?is)<h3\b[^>]*>(.*?)</h3>', chr(10) || '### \1' || chr(10), 'g'),
  '(?i)<(p|div|br|li|article)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS text FROM pages"""


@query("chunk_pages", chunk_sql(_HTML_SQL, "page_id"))
def _(spark, sf):
    pages = src.table(spark, sf, "pages").select(
        "page_id", co.html_headings_to_markdown(F.col("html")).alias("text")
    )
    return co.chunk_documents(pages, key="page_id").drop("token_count")


@query("version_numbering", """
WITH existing AS (SELECT c_nationkey * 2 AS d, c_custkey % 5 + 1 AS v FROM customer),
last AS (SELECT d, max(v) AS v FROM existing GROUP BY d)
SELECT s_nationkey::BIGINT AS document_id, s_suppkey AS upload_seq,
       coalesce(l.v, 0) + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS version_no
FROM supplier LEFT JOIN last l ON l.d = s_nationkey""")
def _(spark, sf):
    existing = src.table(spark, sf, "customer").select(
        (F.col("c_nationkey") * 2).alias("document_id"), (F.col("c_custkey") % 5 + 1).alias("version_no")
    )
    uploads = src.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("document_id"), F.col("s_suppkey").alias("upload_seq")
    )
    return co.version_numbering(existing, uploads)


@query("publish_state", with_tables(f"""
WITH p AS (SELECT *, lead(published_at) OVER (PARTITION BY document_id ORDER BY version_no) AS nxt FROM t_versions
           WHERE published_at <= TIMESTAMP '2024-01-16')
SELECT document_id, version_no, published_at, nxt AS expired_at, CASE WHEN nxt IS NULL THEN 'PUBLISHED' ELSE 'EXPIRED' END AS status,
       nxt IS NULL AND (effective_from IS NULL OR effective_from <= TIMESTAMP '2024-01-16')
         AND (effective_to IS NULL OR effective_to >= TIMESTAMP '2024-01-16') AS visible, nxt IS NULL AS latest FROM p"""))
def _(spark, sf):
    return co.publish_state(src.versions(spark, sf), F.lit("2024-01-16").cast("timestamp"))


@query("corpus_listing", with_tables("""
SELECT d.document_id, d.title, v.versions FROM t_docs d
LEFT JOIN (SELECT document_id, string_agg(version_no || ':' || status, '|' ORDER BY version_no DESC) AS versions FROM t_versions GROUP BY document_id) v USING (document_id)
WHERE d.target_ws IS NULL OR d.target_ws = 1"""))
def _(spark, sf):
    pair = lambda v: F.concat(v["version_no"].cast("string"), F.lit(":"), v["status"])
    return co.corpus_listing(src.docs(spark, sf), src.versions(spark, sf), 1).select(
        "document_id", "title", F.transform("versions", pair).alias("versions")
    )


@query("chunk_drift", with_tables("""
WITH a AS (SELECT document_id // 2 AS d, chunk_no, substring(content, 1, 120) AS p, section_heading AS h FROM t_chunks WHERE document_id % 2 = 0),
b AS (SELECT document_id // 2 AS d, chunk_no, substring(content, 1, 120) AS p, section_heading AS h FROM t_chunks WHERE document_id % 2 = 1)
SELECT coalesce(a.d, b.d) AS document_id, coalesce(a.chunk_no, b.chunk_no) AS chunk_no,
       CASE WHEN b.d IS NULL THEN 'missing_new' WHEN a.d IS NULL THEN 'missing_old' ELSE 'present' END AS status,
       coalesce(a.p = b.p, false) AS same_prefix, a.h IS DISTINCT FROM b.h AS heading_changed
FROM a FULL JOIN b ON a.d = b.d AND a.chunk_no = b.chunk_no"""))
def _(spark, sf):
    rows = src.chunks(spark, sf).withColumns(
        {"version_no": F.col("document_id") % 2, "document_id": F.floor(F.col("document_id") / 2)}
    )
    return co.chunk_drift(rows, 0, 1)


@query("substring_search", with_tables("""
SELECT document_id, q AS query FROM t_docs, (VALUES ('tion'), ('heit'), ('v1.7')) v(q)
WHERE contains(title, q) OR contains(text, q)"""))
def _(spark, sf):
    entries = src.docs(spark, sf).withColumnRenamed("text", "body")
    return co.substring_search(entries, ["tion", "heit", "v1.7"]).select("document_id", "query")


@query("corpus_manifest", with_tables(r"""
SELECT d.document_id, v.n AS version_count, coalesce(c.n, 0) AS chunk_count, v.first_status, c.first_preview
FROM t_docs d JOIN (SELECT document_id, count(*) AS n, max(CASE WHEN version_no = 1 THEN status END) AS first_status FROM t_versions GROUP BY document_id) v USING (document_id)
LEFT JOIN (SELECT document_id, count(*) AS n, max(CASE WHEN chunk_no = 1 AND version_no = 1 THEN substring(regexp_replace(content, '\s+', ' ', 'g'), 1, 120) END) AS first_preview
           FROM t_chunks GROUP BY document_id) c USING (document_id)"""))
def _(spark, sf):
    rows = src.chunks(spark, sf).withColumnRenamed("section_heading", "heading")
    manifest = sinks.corpus_manifest(src.docs(spark, sf), src.versions(spark, sf), rows)
    read = lambda path: F.get_json_object("manifest_json", path)
    return manifest.select(
        "document_id", "version_count", "chunk_count", read("$.versions[0].status").alias("first_status"),
        read("$.versions[0].chunks[0].content_preview").alias("first_preview"),
    )


# --- question texts ------------------------------------------------------------------------

_HINTS = " || ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '|{w}' ELSE '' END" for w in qs.TYPE_HINT_WORDS)
CTES["t_asked"] = """
SELECT doc_id AS query_id, CASE doc_id % 4 WHEN 0 THEN 'CROSS_DOCUMENT' WHEN 1 THEN 'SINGLE_DOCUMENT_FACT' WHEN 2 THEN 'CHITCHAT' ELSE NULL END AS question_type,
       CASE doc_id % 6 WHEN 0 THEN '值班追问：' || text || ' ab-1234 xyz5678 v2.10 2024-3' WHEN 1 THEN text || ' 版本 release 2024年11月'
                       WHEN 2 THEN 'hi' WHEN 3 THEN text || '和' || source || ' 活动的处理流程是什么？' WHEN 4 THEN '你是谁 ' || text ELSE text END AS text
FROM documents"""


def asked(spark, sf):
    i, t = F.col("doc_id"), F.col("text")
    body = (
        F.when(i % 6 == 0, F.concat(F.lit("值班追问："), t, F.lit(" ab-1234 xyz5678 v2.10 2024-3")))
        .when(i % 6 == 1, F.concat(t, F.lit(" 版本 release 2024年11月")))
        .when(i % 6 == 2, F.lit("hi"))
        .when(i % 6 == 3, F.concat(t, F.lit("和"), F.col("source"), F.lit(" 活动的处理流程是什么？")))
        .when(i % 6 == 4, F.concat(F.lit("你是谁 "), t))
        .otherwise(t)
    )
    kind = F.when(i % 4 == 0, "CROSS_DOCUMENT").when(i % 4 == 1, "SINGLE_DOCUMENT_FACT").when(i % 4 == 2, "CHITCHAT")
    return src.table(spark, sf, "documents").select(i.alias("query_id"), kind.alias("question_type"), body.alias("text"))


_IDS_SQL = r"""list_concat(regexp_extract_all(upper(text), '\b([A-Z]{2,6}-\d{3,6})\b', 1),
  list_transform(regexp_extract_all(upper(text), '\b([A-Z]{2,6}\d{3,6})\b', 1), lambda x: regexp_replace(x, '^([A-Z]+)(\d+)$', '\1-\2')))"""
CTES["t_asked_ids"] = f"""
SELECT query_id, id AS identifier FROM (SELECT query_id, unnest(list_distinct({_IDS_SQL})) AS id FROM t_asked) q"""


@query("identifier_extract", with_tables("""
SELECT a.query_id, coalesce(string_agg(i.identifier, '|' ORDER BY i.identifier), '') AS ids FROM t_asked a LEFT JOIN t_asked_ids i USING (query_id) GROUP BY a.query_id"""))
def _(spark, sf):
    return asked(spark, sf).select("query_id", F.array_sort(qs.identifiers(F.col("text"))).alias("ids"))


@query("query_expand", with_tables(rf"""
WITH p AS (SELECT query_id, text, regexp_extract_all(text, '(?i)\bv?(\d+(?:\.\d+)+)\b', 1) AS vs, {_IDS_SQL} AS ids,
    regexp_extract_all(text, '\d{{4}}[-/年]\d{{1,2}}') AS ym, regexp_extract_all(text, '\d{{1,2}}月') AS ms, string_split({_HINTS}, '|') AS hints FROM t_asked),
w AS (SELECT query_id, text, list_concat([regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')],
    flatten(list_transform(vs, lambda v: [v, 'v' || v])), flatten(list_transform(ids, lambda x: [x, replace(x, '-', '')])),
    flatten(list_transform(ym, lambda x: [regexp_extract(x, '(\d{{4}})', 1) || '-' || lpad(regexp_extract(x, '[-/年](\d{{1,2}})', 1), 2, '0'), regexp_extract(x, '[-/年](\d{{1,2}})', 1) || '月'])),
    ms, list_filter(hints, lambda h: h <> '')) AS ws FROM p)
SELECT query_id, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') AS expanded FROM w"""))
def _(spark, sf):
    return asked(spark, sf).select("query_id", qs.query_expand(F.col("text")).alias("expanded"))


_ROUTES = " || ".join(
    "CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '|{t}' ELSE '' END" for t, words in qs.ROUTE_WORDS
)


@query("type_route", with_tables(f"SELECT query_id, ltrim({_ROUTES}, '|') AS types FROM t_asked"))
def _(spark, sf):
    return asked(spark, sf).select("query_id", qs.type_route(F.col("text")).alias("types"))


@query("chitchat_guard", with_tables(r"""
SELECT query_id, coalesce(question_type IN ('CHITCHAT', 'NO_ANSWER'), false) OR t = '' OR lower(t) IN ('hi', 'hello') OR starts_with(t, '你是谁') OR length(t) <= 2 AS abstain
FROM (SELECT query_id, question_type, regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS t FROM t_asked) q"""))
def _(spark, sf):
    return asked(spark, sf).select("query_id", qs.force_abstain(F.col("text"), F.col("question_type")).alias("abstain"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[？?。；;，,\s]+$', ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _sql_parts(x: str, delimiter: str, minimum: int) -> str:
    cleaned = f"list_transform(regexp_split_to_array({x}, '{delimiter}'), lambda p: {_CLEAN.format('p')})"
    return f"list_filter({cleaned}, lambda p: length(p) >= {minimum})"


# The test questions have no shared `的…` tail before their question mark except "的处理流程是什么".
@query("subquery_split", with_tables(rf"""
WITH b AS (SELECT query_id, question_type, regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS t,
    CASE WHEN starts_with(text, '值班追问') THEN '值班追问：' ELSE '' END AS scene FROM t_asked),
c AS (SELECT *, regexp_replace(regexp_replace(t, '^值班追问[：:，,\s]*', ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS body FROM b),
d AS (SELECT *, {_sql_parts('body', '[，,]', 8)} AS commas, {_sql_parts('body', '[和与以及]', 4)} AS joined, {_sql_parts('body', '[？?]', 6)} AS asks,
    coalesce(question_type = 'CROSS_DOCUMENT', false) OR (regexp_matches(body, '[和与以及，,]') AND regexp_matches(body, '[？?吗]')) AS wanted FROM c),
e AS (SELECT *, CASE WHEN len(commas) >= 2 THEN commas
    WHEN len(joined) >= 2 THEN CASE WHEN ends_with(body, '的处理流程是什么？') AND NOT contains(joined[1], '？') AND NOT contains(joined[1], '?') AND NOT contains(joined[1], '吗')
         THEN [joined[1] || '的处理流程是什么', joined[2]] ELSE joined END
    WHEN len(asks) >= 2 THEN asks ELSE [body] END AS parts FROM d),
f AS (SELECT query_id, CASE WHEN wanted AND len(parts) >= 2 THEN list_transform(parts, lambda p: scene || p) ELSE [t] END AS parts FROM e)
SELECT query_id, unnest(generate_series(1, len(parts))) AS sub_no, unnest(parts) AS text FROM f"""))
def _(spark, sf):
    return rt.split_subqueries(asked(spark, sf))


_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_FIRSTS = "list_filter({}, lambda x, i: list_position({}, x) = i)"
_UNSCENED = rf"regexp_replace({_TRIM.format('whole')}, '^({qs.SCENES})[：:，,\s]*', '')"
_JOINER, _OTHER, _ANY = qs.CONNECTORS, qs.NOT_CONNECTOR, r"[^\n\r\x{85}\x{2028}\x{2029}]"


def _holding(x: str, words: dict[str, list[str]]) -> str:
    """The keys of those lists of which `x` contains a word."""
    some = lambda ws: " OR ".join(f"contains({x}, '{w}')" for w in ws)
    return "list_filter([" + ", ".join(f"CASE WHEN {some(ws)} THEN '{k}' END" for k, ws in words.items()) + "], lambda x: x IS NOT NULL)"


_HINT_LISTS = {
    "postmortem": ["复盘", "postmortem"], "operation": ["活动", "签到", "维护"], "faq": ["faq", "常见问题"], "release": ["公告", "版本", "热修"],
}
_STOP = ", ".join(f"'{w}'" for w in qs.STOP_TOKENS)
_BEFORE_FAQ = _holding("title", {a: [a] for a in qs.TITLE_ANCHORS_BEFORE_FAQ})
# From `u` on there is a row per text that signals are found in: the whole question (k = 0) and each of its groups. In `text`
# letters and digits beyond ASCII are `_`, because Java's word ends, other than RE2's, are not next to them.
CTES["t_signals"] = rf"""
WITH b AS MATERIALIZED (SELECT *, {_TRIM.format(_UNSCENED)} AS body
    FROM (SELECT row_number() OVER () AS no, query_id, question_type, coalesce(text, '') AS whole FROM t_asked) q),
c AS (SELECT no, body, {_sql_parts('body', '[，,]', 8)} AS commas, {_sql_parts('body', _JOINER, 4)} AS joined, {_sql_parts('body', '[？?]', 6)} AS asks,
    regexp_extract(body, '^{_OTHER}+{_JOINER}{_OTHER}+?(的{_ANY}+)$', 1) AS named,
    regexp_extract(body, '^{_OTHER}+{_JOINER}{_OTHER}+?({_ANY}+[吗？?]{_ANY}*)$', 1) AS question FROM b),
d AS (SELECT *, CASE WHEN named <> '' THEN {_CLEAN.format('named')} WHEN question <> '' THEN {_CLEAN.format('question')} ELSE body END AS tail FROM c),
e AS (SELECT *, starts_with(tail, '的') AND tail <> body AS shared, list_transform(joined, lambda p, i: CASE WHEN regexp_matches(p, '[？?吗]')
    OR (i = len(joined) AND contains(p, regexp_replace(tail, '[？?。；;，,\s]+$', ''))) THEN p ELSE p || tail END) AS told FROM d),
h AS (SELECT *, CASE WHEN shared AND len(joined) >= 2 THEN {_FIRSTS.format('told', 'told')} ELSE joined END AS sides FROM e),
p AS (SELECT no, CASE WHEN len(commas) >= 2 THEN commas WHEN len(sides) >= 2 THEN sides
    WHEN len(asks) >= 2 THEN asks ELSE list_filter(list_transform(regexp_split_to_array(body, '{_JOINER}'), lambda x: {_TRIM.format('x')}), lambda x: x <> '' AND regexp_matches(body, '{_JOINER}')) END AS parts FROM h),
u AS (SELECT no, 0 AS k, whole AS said FROM b UNION ALL SELECT no, unnest(generate_series(1, len(parts))), unnest(parts) FROM p),
t AS (SELECT no, k, regexp_replace(said, '[^\x00-\x7F\pP\pS\pZ\pM\pC\p{{Nl}}\p{{No}}]', '_', 'g') AS text, lower({_TRIM.format('said')}) AS title FROM u),
f AS (SELECT *, regexp_replace(title, '[？?。；;，,：:\x0B\s]+', ' ', 'g') AS flat FROM t),
w AS (SELECT *, list_filter(list_transform(string_split(flat, ' '), lambda x: {_TRIM.format('x')}), lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) AS words,
    list_filter(regexp_extract_all(flat, '[一-鿿]{{2,8}}'), lambda x: x NOT IN ({_STOP})) AS runs FROM f),
v AS (SELECT *, regexp_extract_all(text, '(?i)\bv?(\d+(?:\.\d+)+)\b', 1) AS vs, {_IDS_SQL} AS codes FROM w),
a AS (SELECT *, list_concat(vs, flatten(list_transform(words, lambda x: CASE WHEN length(x) > 4 THEN [x, x[1:4]] ELSE [x] END)),
    flatten(list_transform(runs, lambda x: CASE WHEN length(x) > 3 THEN [x, x[1:2], x[1:4]] WHEN length(x) > 2 THEN [x, x[1:2]] ELSE [x] END))) AS heads,
    {_BEFORE_FAQ} AS faqs FROM v),
s AS (SELECT no, k, {_FIRSTS.format('heads', 'heads')} AS tokens, {_FIRSTS.format('vs', 'vs')} AS versions, {_FIRSTS.format('codes', 'codes')} AS ids,
    list_concat(faqs, CASE WHEN contains(title, 'faq') AND faqs = [] THEN ['faq'] ELSE [] END, {_holding('title', {x: [x] for x in qs.TITLE_ANCHORS})}) AS anchors FROM a),
g AS (SELECT no, flatten(list(tokens ORDER BY k)) AS ts, flatten(list(versions ORDER BY k)) AS vs, flatten(list(ids ORDER BY k)) AS codes,
    string_agg(concat_ws(';', array_to_string(tokens, ','), array_to_string(versions, ','), array_to_string(ids, ','), array_to_string(anchors, ',')), '|' ORDER BY k) AS groups
    FROM s WHERE k > 0 GROUP BY no),
o AS (SELECT b.query_id, b.question_type, {_holding('lower(whole)', _HINT_LISTS)} AS hints, coalesce(g.ts, s.tokens) AS ts,
    list_concat(s.versions, coalesce(g.vs, [])) AS vs, list_concat(s.ids, coalesce(g.codes, [])) AS codes, coalesce(g.groups, '') AS groups
    FROM b JOIN s ON s.no = b.no AND s.k = 0 LEFT JOIN g ON g.no = b.no)
SELECT query_id, question_type, hints, groups, {_FIRSTS.format('ts', 'ts')} AS tokens, {_FIRSTS.format('vs', 'vs')} AS versions, {_FIRSTS.format('codes', 'codes')} AS ids FROM o"""


@query("entity_signals", with_tables("""
SELECT query_id, question_type, len(versions) AS n_versions, len(hints) AS n_hints, len(ids) AS n_ids, array_to_string(tokens, '|') AS tokens,
       array_to_string(versions, '|') AS versions, array_to_string(ids, '|') AS ids, array_to_string(hints, '|') AS hints, groups FROM t_signals"""))
def _(spark, sf):
    """All signals, so that none is left out as unread. In a group no list can hold a `;`, and none but the anchors a blank."""
    names = ("tokens", "versions", "ids", "anchors")
    shown = F.transform("groups", lambda g: F.concat_ws(";", *[F.array_join(g[n], ",") for n in names]))
    return sl.entity_signals(asked(spark, sf)).select(
        "query_id", "question_type", F.size("versions").alias("n_versions"), F.size("hints").alias("n_hints"), F.size("ids").alias("n_ids"),
        "tokens", "versions", "ids", "hints", shown.alias("groups"),
    )


@query("entity_signal_rows")
def _(spark, sf):
    return sl.signal_rows(sl.entity_signals(asked(spark, sf)))


# --- index texts ---------------------------------------------------------------------------

_PRESENT = r"nullif(regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '')"


@query("lexical_index_text", with_tables(f"""
SELECT chunk_id, concat_ws(' ', {_PRESENT.format('title')}, document_type, 'v' || version_no, section_heading, {_PRESENT.format('content')}) AS index_text FROM t_items"""))
def _(spark, sf):
    c = F.col
    text = qs.lexical_index_text(c("title"), c("document_type"), c("version_no"), c("section_heading"), c("content"))
    return src.items(spark, sf).select("chunk_id", text.alias("index_text"))


_ISO = "strftime({}, '%Y-%m-%dT%H:%MZ')"


@query("embed_text", with_tables(f"""
SELECT c.chunk_id, '[' || c.title || ' | ' || c.document_type || ' | v' || c.version_no ||
  CASE WHEN v.effective_from IS NULL AND v.effective_to IS NULL THEN '' ELSE ' | ' || coalesce({_ISO.format('v.effective_from')}, '*') || '~' || coalesce({_ISO.format('v.effective_to')}, '*') END ||
  CASE WHEN v.owner IS NOT NULL THEN ' | owner:' || v.owner ELSE '' END || ']' || chr(10) ||
  CASE WHEN v.fact_boundary IS NOT NULL THEN '事实边界: ' || v.fact_boundary || chr(10) ELSE '' END ||
  CASE WHEN c.section_heading IS NOT NULL THEN '## ' || c.section_heading || chr(10) ELSE '' END || c.content ||
  CASE WHEN a.content IS NOT NULL THEN chr(10) || '[上文: ' || right({_PRESENT.format('a.content')}, 20) || ']' ELSE '' END ||
  CASE WHEN b.content IS NOT NULL THEN chr(10) || '[下文: ' || left({_PRESENT.format('b.content')}, 20) || ']' ELSE '' END AS embed_text
FROM t_items c JOIN t_versions v USING (document_id, version_no)
LEFT JOIN t_chunks a ON a.document_id = c.document_id AND a.chunk_no = c.chunk_no - 1
LEFT JOIN t_chunks b ON b.document_id = c.document_id AND b.chunk_no = c.chunk_no + 1"""))
def _(spark, sf):
    chunks = src.chunks(spark, sf)
    heads = src.docs(spark, sf).select("document_id", "title", "document_type")
    versions = src.versions(spark, sf).drop("version_id")
    return rt.embed_text(chunks, heads, versions, neighbour=20).select("chunk_id", "embed_text")


@query("rerank_text", with_tables(f"""
SELECT chunk_id, 'title: ' || title || chr(10) || 'type: ' || document_type || chr(10) || 'version: v' || version_no || chr(10) || 'effective: -' || chr(10) ||
       'section: ' || coalesce(section_heading, '-') || chr(10) || regexp_replace('content: ' || coalesce(substring({_PRESENT.format('content')}, 1, 1200), '-'), '[\\x00-\\x20]+$', '') AS rerank_text FROM t_items"""))
def _(spark, sf):
    c = F.col
    none = F.lit(None).cast("string")
    text = qs.rerank_text(c("title"), c("document_type"), c("version_no"), none, c("section_heading"), c("content"))
    return src.items(spark, sf).select("chunk_id", text.alias("rerank_text"))


@query("effective_window_label", with_tables("""
SELECT version_id, CASE WHEN effective_from IS NULL AND effective_to IS NULL THEN 'always'
  ELSE coalesce(strftime(effective_from, '%Y-%m-%d'), 'open') || '..' || coalesce(strftime(effective_to, '%Y-%m-%d'), 'open') END AS label FROM t_versions"""))
def _(spark, sf):
    label = qs.effective_window_label(F.col("effective_from"), F.col("effective_to"))
    return src.versions(spark, sf).select("version_id", label.alias("label"))


CTES["t_visible"] = f"""
SELECT c.chunk_id, c.document_id, d.document_type FROM t_chunks c JOIN t_versions v USING (document_id, version_no) JOIN t_docs d USING (document_id)
WHERE d.org_id = 1 AND (d.target_ws IS NULL OR d.target_ws = 3) AND v.status = 'PUBLISHED'
  AND (v.effective_from IS NULL OR v.effective_from <= TIMESTAMP '{AS_OF}') AND (v.effective_to IS NULL OR v.effective_to >= TIMESTAMP '{AS_OF}')
  AND d.document_type IN ('KNOWN_ISSUE', 'SENTIMENT_PLAYBOOK', 'POSTMORTEM')"""


@query("visible_chunks", with_tables("SELECT chunk_id, document_id, document_type FROM t_visible"))
def _(spark, sf):
    rows = rt.visible_chunks(
        src.chunks(spark, sf), src.versions(spark, sf).drop("version_id"), src.docs(spark, sf), 1, 3, src.as_of(),
        ["KNOWN_ISSUE", "SENTIMENT_PLAYBOOK", "POSTMORTEM"],
    )
    return rows.select("chunk_id", "document_id", "document_type")


# --- identifiers ---------------------------------------------------------------------------

# Questions name the identifiers that occur in the corpus, one question per document.
CTES["t_id_hits"] = """
SELECT DISTINCT i.identifier, c.version_id, c.chunk_no, c.chunk_id FROM (SELECT DISTINCT identifier FROM t_id_wanted) i
JOIN t_id_items c ON contains(upper(c.title || chr(10) || c.content || chr(10) || coalesce(c.lexical_text, '')), i.identifier)"""
CTES["t_id_wanted"] = r"""
SELECT query_id, id AS identifier FROM (SELECT doc_id AS query_id, unnest(list_distinct(regexp_extract_all(
  upper(regexp_replace(text, '([A-Za-z]{2,6})(\d{3,6})', '\1-\2', 'g')), '[A-Z]{2,6}-\d{3,6}'))) AS id FROM documents) q"""
CTES["t_id_items"] = r"""
SELECT chunk_id, version_id, chunk_no, title, lexical_text, regexp_replace(content, '([A-Za-z]{2,6})(\d{3,6})', '\1-\2', 'g') AS content FROM t_items"""
CTES["t_id_neighbours"] = """
SELECT DISTINCT h.identifier, c.chunk_id FROM t_id_hits h JOIN t_id_items c ON c.version_id = h.version_id AND c.chunk_no IN (h.chunk_no - 1, h.chunk_no + 1)"""


def id_items(spark, sf):
    """Chunks with compact identifiers written with their dash, so that the corpus holds some."""
    dashed = F.regexp_replace("content", r"([A-Za-z]{2,6})(\d{3,6})", "$1-$2")
    return src.items(spark, sf).withColumn("content", dashed)


def id_questions(spark, sf):
    """One question per document, naming what looks like an identifier in it."""
    dashed = F.upper(F.regexp_replace("text", r"([A-Za-z]{2,6})(\d{3,6})", "$1-$2"))
    named = F.array_join(F.regexp_extract_all(dashed, F.lit(r"[A-Z]{2,6}-\d{3,6}"), F.lit(0)), " ")
    return src.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), named.alias("text"))


@query("identifier_supplement", with_tables("""
SELECT w.query_id, w.identifier, u.chunk_id, 0.12::DOUBLE AS score FROM t_id_wanted w
JOIN (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY chunk_id) AS n FROM
      (SELECT identifier, chunk_id FROM t_id_hits UNION SELECT identifier, chunk_id FROM t_id_neighbours) q) u ON u.identifier = w.identifier AND u.n <= 5"""))
def _(spark, sf):
    return rt.identifier_supplement(id_questions(spark, sf), id_items(spark, sf))


@query("identifier_union", with_tables("""
SELECT identifier, chunk_id, round(max(s), 9) AS score FROM (SELECT identifier, chunk_id, 0.12::DOUBLE AS s FROM t_id_hits
  UNION ALL SELECT identifier, chunk_id, 0.12::DOUBLE * 0.85::DOUBLE FROM t_id_neighbours) q GROUP BY identifier, chunk_id"""), digits=9)
def _(spark, sf):
    chunks = id_items(spark, sf)
    named = id_questions(spark, sf).select(F.explode_outer(qs.identifiers(F.col("text"))).alias("identifier"))
    hits = rt.identifier_hits(named.filter("identifier IS NOT NULL"), chunks)
    near = rt.identifier_neighbours(hits, chunks, 0.12 * 0.85)
    return rt.identifier_union(hits.withColumn("score", F.lit(0.12)), near)


# --- arms and fusion -----------------------------------------------------------------------


@query("vector_distance", """
SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], m::DOUBLE[]), 9) AS distance FROM embeddings,
  (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x) AS a FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) q GROUP BY i) r) c""", digits=9)
def _(spark, sf):
    vectors = src.table(spark, sf, "embeddings")
    mean = (
        vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("a"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda p: p["a"]).alias("m"))
    )
    one = F.lit(1)
    return vectors.withColumn("_one", one).join(F.broadcast(mean.withColumn("_one", one)), "_one").select(
        "vec_id", tx.cosine_distance(F.col("embedding"), F.col("m")).alias("distance")
    )


@query("vector_arm", with_tables("SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM t_near_full"), digits=9)
def _(spark, sf):
    return src.near(spark, sf, 40)


CTES["t_grams"] = r"""
SELECT kind, id, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(coalesce(t, '')), '[^\p{L}\p{N}]+'), lambda w: w <> ''),
  lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substring('  ' || w || ' ', CAST(i AS BIGINT), 3))))) AS g
FROM (SELECT 'q' AS kind, item_id AS id, text AS t FROM benchmark UNION ALL SELECT 'e', item_id, text || ' v1.2' FROM benchmark
  UNION ALL SELECT 'title', chunk_id, title FROM t_items UNION ALL SELECT 'section', chunk_id, section_heading FROM t_items
  UNION ALL SELECT 'tag', chunk_id, 'v' || version_no FROM t_items UNION ALL SELECT 'number', chunk_id, version_no::VARCHAR FROM t_items
  UNION ALL SELECT 'body', chunk_id, content FROM t_items) s"""
CTES["t_gram_rows"] = "SELECT kind, id, len(g) AS n, unnest(g) AS x FROM t_grams WHERE len(g) > 0"
CTES["t_similar"] = """
SELECT q.kind AS qk, q.id AS query_id, c.kind AS ck, c.id AS chunk_id, count(*) / (q.n + c.n - count(*))::DOUBLE AS s
FROM t_gram_rows q JOIN t_gram_rows c ON q.x = c.x WHERE q.kind IN ('q', 'e') AND c.kind NOT IN ('q', 'e') GROUP BY q.kind, q.id, q.n, c.kind, c.id, c.n"""
CTES["t_lexical"] = """
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(3.0 * t + 2.0 * s + 2.5 * v + 1.0 * b, 9) AS score FROM (
    SELECT query_id, chunk_id, coalesce(max(s) FILTER (qk = 'q' AND ck = 'title'), 0)::DOUBLE AS t, coalesce(max(s) FILTER (qk = 'q' AND ck = 'section'), 0)::DOUBLE AS s,
           coalesce(max(s) FILTER (ck IN ('tag', 'number')), 0)::DOUBLE AS v, coalesce(max(s) FILTER (qk = 'q' AND ck = 'body'), 0)::DOUBLE AS b
    FROM t_similar GROUP BY query_id, chunk_id) p WHERE b >= 0.15 OR t >= 0.12 OR s >= 0.12 OR v >= 0.12) r"""


def lexical(spark, sf, k=40, items=None):
    asked_texts = src.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", F.concat("text", F.lit(" v1.2")).alias("expanded")
    )
    return se.lexical_arm(asked_texts, src.items(spark, sf) if items is None else items, k)


@query("trigram_similarity", with_tables("SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM t_lexical WHERE rank <= 40"), digits=9)
def _(spark, sf):
    return lexical(spark, sf)


CTES["t_doc_words"] = r"""
SELECT chunk_id, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM t_chunks"""
CTES["t_covers"] = r"""
WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS wanted FROM benchmark),
m AS (SELECT query_id, chunk_id, wanted, w FROM q JOIN t_doc_words ON len(wanted) > 0 AND list_has_all(w, wanted)),
e AS (SELECT query_id, chunk_id, len(wanted) AS size, unnest(w) AS word, unnest(range(len(w))) AS pos, wanted FROM m),
h AS (SELECT query_id, chunk_id, size, word, pos, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS nth
      FROM e WHERE list_contains(wanted, word)),
s AS (SELECT a.query_id, a.chunk_id, a.pos, a.nth, a.size, b.word, max(b.pos) AS last, max(b.nth) AS last_at
      FROM h a JOIN h b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.pos <= a.pos GROUP BY ALL),
c AS (SELECT query_id, chunk_id, pos, nth, min(last) AS low, min(last_at) AS low_at FROM s
      GROUP BY query_id, chunk_id, pos, nth, size HAVING count(*) = size),
f AS (SELECT query_id, chunk_id, low, min(pos) AS pos, min(nth) AS nth, any_value(low_at) AS low_at FROM c GROUP BY query_id, chunk_id, low)
SELECT query_id, chunk_id, round(sum(0.1::DOUBLE / (1 + (pos - low) - (nth - low_at)) ORDER BY pos), 12) AS score FROM f GROUP BY query_id, chunk_id"""


@query("legacy_lexical", with_tables("""
SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM t_covers) r WHERE rank <= 32"""), digits=9)
def _(spark, sf):
    asked_texts = src.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rt.legacy_lexical(asked_texts, src.chunks(spark, sf))


CTES["t_fused"] = """
SELECT query_id, chunk_id, score, source_kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score,
         CASE WHEN b.rank IS NULL THEN 'lexical' WHEN a.rank IS NULL THEN 'vector' ELSE 'both' END AS source_kind
  FROM t_near_half a FULL JOIN t_near_full b USING (query_id, chunk_id)) q"""
CTES["t_fused_top"] = "SELECT * FROM t_fused WHERE rank <= 50"


def arms(spark, sf):
    return src.near(spark, sf, 40, 32), src.near(spark, sf, 40)


def fused(spark, sf):
    return rt.rrf_fuse(*arms(spark, sf))


@query("rrf_fuse", with_tables("SELECT query_id, chunk_id, round(score, 9) AS score, source_kind, rank FROM t_fused_top"), digits=9)
def _(spark, sf):
    return fused(spark, sf).select("query_id", "chunk_id", "score", "source_kind", "rank")


@query("provenance_sets", with_tables("SELECT query_id, chunk_id, source_kind FROM t_fused"))
def _(spark, sf):
    return rt.provenance_sets(*arms(spark, sf)).select("query_id", "chunk_id", "source_kind")


# Two vectors form one question with two sub-queries.
CTES["t_lists"] = "SELECT query_id // 2 AS query_id, query_id % 2 + 1 AS sub_no, chunk_id, rank, score, source_kind FROM t_fused_top"


def lists(spark, sf):
    q = F.col("query_id")
    return fused(spark, sf).select(
        F.floor(q / 2).alias("query_id"), (q % 2 + 1).alias("sub_no"), "chunk_id", "rank", "score", "source_kind"
    )


_KIND = """CASE WHEN bool_or(source_kind IN ('lexical', 'both')) AND bool_or(source_kind IN ('vector', 'both')) THEN 'both'
  WHEN bool_or(source_kind IN ('lexical', 'both')) THEN 'lexical' ELSE 'vector' END"""
CTES["t_sub_merged"] = f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, coalesce(max(CASE WHEN sub_no = 1 THEN 1.0::DOUBLE / (60 + rank) END), 0) + coalesce(max(CASE WHEN sub_no = 2 THEN 1.0::DOUBLE / (60 + rank) END), 0) AS score,
         {_KIND} AS source_kind FROM t_lists GROUP BY query_id, chunk_id) q"""


@query("subquery_rrf", with_tables("SELECT query_id, chunk_id, round(score, 9) AS score, source_kind, rank FROM t_sub_merged WHERE rank <= 50"), digits=9)
def _(spark, sf):
    return rt.subquery_rrf(lists(spark, sf))


@query("round_merge", with_tables(f"""
SELECT query_id, chunk_id, round(score, 9) AS score, source_kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, max(score) AS score, {_KIND} AS source_kind FROM (
    SELECT query_id, chunk_id, score, 'lexical' AS source_kind FROM t_near_half UNION ALL SELECT query_id, chunk_id, score, 'vector' FROM t_near_full) u GROUP BY query_id, chunk_id) q) r WHERE rank <= 50"""), digits=9)
def _(spark, sf):
    half, full = arms(spark, sf)
    return rt.round_merge(
        half.withColumn("source_kind", F.lit("lexical")), full.withColumn("source_kind", F.lit("vector"))
    )


@query("evidence_gate", with_tables("""
WITH c AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank = 1 THEN score END) AS top, count(*) FILTER (score >= 0.0164) AS ok FROM t_fused_top GROUP BY query_id),
j AS (SELECT e.vec_id AS query_id, e.label = 3 AS f, coalesce(n, 0) AS n, coalesce(top, 0) AS top, coalesce(ok, 0) AS ok FROM embeddings e LEFT JOIN c ON c.query_id = e.vec_id)
SELECT query_id, CASE WHEN NOT f AND top >= 0.02 AND ok > 0 THEN 'INJECT' ELSE 'ABSTAIN' END AS outcome, n AS input_count,
       CASE WHEN NOT f AND top >= 0.02 AND ok > 0 THEN ok ELSE 0 END AS injected_count, round(top, 9) AS top_score FROM j"""), digits=9)
def _(spark, sf):
    questions = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    return rt.evidence_gate(fused(spark, sf), questions, F.col("label") == 3)


# --- selection -----------------------------------------------------------------------------


def judged(spark, sf):
    """Fused candidates and the relevance of those the full arm scored; that arm is made once."""
    half, full = arms(spark, sf)
    full = materialize(full)
    relevance = full.filter("chunk_id % 5 <> 0").select("query_id", "chunk_id", F.col("score").alias("relevance"))
    return with_documents(rt.rrf_fuse(half, full)), relevance


def with_documents(df):
    return df.withColumn("document_id", F.floor(F.col("chunk_id") / 8))


@query("rerank_blend", with_tables("""
WITH p AS (SELECT query_id, chunk_id, rank AS rrf_rank FROM t_fused WHERE rank <= 30),
r AS (SELECT p.*, f.score AS rel FROM p LEFT JOIN (SELECT * FROM t_near_full WHERE chunk_id % 5 <> 0) f USING (query_id, chunk_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC NULLS LAST, rrf_rank) AS rr, count(*) OVER (PARTITION BY query_id) AS n FROM r),
s AS (SELECT *, 0.75::DOUBLE * (1.0 - (rr - 1)::DOUBLE / (n - 1)) + 0.25::DOUBLE * (1.0 - (rrf_rank - 1)::DOUBLE / (n - 1)) AS score FROM o)
SELECT query_id, chunk_id, chunk_id // 8 AS document_id, round(score, 9) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rr, rrf_rank) AS rank FROM s) q WHERE rank <= 8"""), digits=9)
def _(spark, sf):
    return sl.rerank_blend(*judged(spark, sf), w=0.25)


@query("rerank_diverse")
def _(spark, sf):
    return sl.rerank_blend(*judged(spark, sf), w=0.25, div=0.05)


def lexical_candidates(spark, sf):
    """The lexical arm with what is shown of its chunks; texts are cut into chunks once."""
    items = stored(src.items(spark, sf))
    found = materialize(lexical(spark, sf, items=items))
    shown = items.select("chunk_id", "document_id", "title", "section_heading", "content", "document_type")
    return small_side(found).join(shown, "chunk_id")


def lexical_signals(spark, sf, composite=False):
    text = F.concat(F.lit("v1.3 "), "text") if not composite else F.concat("text", F.lit("和 part 0 v1.4 说明"))
    return sl.entity_signals(
        src.table(spark, sf, "benchmark").select(
            F.col("item_id").alias("query_id"), text.alias("text"), F.lit("CROSS_DOCUMENT").alias("question_type")
        )
    )


@query("entity_boost")
def _(spark, sf):
    return sl.entity_boost(lexical_candidates(spark, sf), lexical_signals(spark, sf, True))


@query("coverage_select")
def _(spark, sf):
    return sl.coverage_select(lexical_candidates(spark, sf), lexical_signals(spark, sf, True))


@query("coverage_select_plain", with_tables("SELECT query_id, chunk_id, document_id, round(score, 9) AS score, rank FROM t_lexical JOIN t_items USING (chunk_id) WHERE rank <= 8"), digits=9)
def _(spark, sf):
    no_type = lexical_signals(spark, sf).drop("question_type").withColumn("groups", F.filter("groups", lambda g: F.lit(False)))
    return sl.coverage_select(lexical_candidates(spark, sf), no_type)


@query("subquery_quota")
def _(spark, sf):
    candidates = lexical_candidates(spark, sf)
    parts = candidates.withColumn("sub_no", F.col("chunk_id") % 2 + 1)
    parts = parts.select("query_id", "sub_no", "chunk_id", F.ceil(F.col("rank") / 2).alias("rank"))
    return sl.subquery_quota(candidates, parts, lexical_signals(spark, sf, True))


@query("section_expand", with_tables("""
WITH s AS (SELECT version_id, coalesce(section_heading, '') AS section, sum(length(content) + 1) - 1 AS chars, string_agg(content, chr(10) ORDER BY chunk_no) AS whole
           FROM t_chunks GROUP BY version_id, coalesce(section_heading, '')),
b AS (SELECT version_id, coalesce(section_heading, '') AS section, content, min(chunk_no) AS anchor FROM t_chunks GROUP BY ALL),
o AS (SELECT version_id, coalesce(section_heading, '') AS section, chunk_no, content,
        lag(content) OVER w AS before, lead(content) OVER w AS after FROM t_chunks WINDOW w AS (PARTITION BY version_id, coalesce(section_heading, '') ORDER BY chunk_no))
SELECT c.chunk_id AS query_id, c.chunk_id, CASE WHEN s.chars <= 1000 THEN s.whole
    WHEN a.before IS NOT NULL AND length(a.before) + 1 + length(a.content) <= 1000 THEN a.before || chr(10) || a.content
    WHEN a.after IS NOT NULL AND length(a.after) + 1 + length(a.content) <= 1000 THEN a.content || chr(10) || a.after ELSE a.content END AS snippet
FROM t_chunks c JOIN s ON s.version_id = c.version_id AND s.section = coalesce(c.section_heading, '')
JOIN b ON b.version_id = c.version_id AND b.section = s.section AND b.content = c.content
JOIN o a ON a.version_id = c.version_id AND a.section = s.section AND a.chunk_no = b.anchor"""))
def _(spark, sf):
    chunks = src.chunks(spark, sf)
    return rt.section_expand(chunks.select(F.col("chunk_id").alias("query_id"), "chunk_id"), chunks)


@query("retrieval_batch")
def _(spark, sf):
    """The whole batch: texts of `benchmark` as questions with the vectors of the same numbers, where there are any."""
    vectors = src.table(spark, sf, "embeddings")
    asked_texts = src.table(spark, sf, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id"), "left").select(
        F.col("item_id").alias("query_id"), "text", F.lit("CROSS_DOCUMENT").alias("question_type"), "embedding"
    )
    holders = src.items(spark, sf).join(
        vectors.select(F.col("vec_id").alias("document_id"), "embedding"), "document_id", "left"
    )
    return retrieve(asked_texts, holders)["gate"]
