"""Evaluation: matching, metrics, comparisons, datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvox.catalog import inputs as src
from tallyvox.catalog.base import query
from tallyvox.catalog.inputs import CTES, with_tables
from tallyvox.functions import text as tx
from tallyvox.operators import evaluation as ev
from tallyvox.operators import retrieval as rt
from tallyvox.operators import selection as sl
from tallyvox.session import materialize

_NORMAL = r"regexp_replace(replace(replace(lower(coalesce({}, '')), '-', ''), '_', ''), '[\s，。；、：！？,.!?;:]', '', 'g')"
_NORMAL_KEEP = r"regexp_replace(lower(coalesce({}, '')), '[\s，。；、：！？,.!?;:]', '', 'g')"


@query("answer_normalize", f"SELECT doc_id, {_NORMAL.format('text')} AS normalized FROM documents")
def _(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", tx.answer_normalize(F.col("text")).alias("normalized"))


def _holds(answer: str, claim: str) -> str:
    words = r"list_distinct(regexp_extract_all({}, '[a-z0-9]{{2,}}'))"
    a, c = words.format(answer), words.format(claim)
    return f"""CASE WHEN {claim} = '' OR {answer} = '' THEN false WHEN contains({answer}, {claim}) THEN true WHEN length({claim}) < 12 THEN false
      ELSE len({c}) > 0 AND len(list_intersect({c}, {a})) / len({c})::DOUBLE >= 0.6 END"""


CTES["t_checked"] = f"""
SELECT case_key, sort_order, assertion_type, {_holds('a', 'c')} AS holds FROM (
  SELECT s.case_key, s.sort_order, s.assertion_type, {_NORMAL.format('w.answer')} AS a, {_NORMAL.format('s.assertion_text')} AS c
  FROM t_assertions s LEFT JOIN t_answers w USING (case_key)) q"""


@query("assertion_match", with_tables("SELECT case_key, sort_order::BIGINT AS sort_order, holds FROM t_checked"))
def _(spark, sf):
    normal = tx.answer_normalize
    said = src.answer_texts(spark, sf).select("case_key", normal(F.col("answer")).alias("a"))
    claims = src.assertions(spark, sf).withColumn("c", normal(F.col("assertion_text")))
    holds = tx.assertion_match(F.coalesce("a", F.lit("")), F.col("c"))
    return claims.join(said, "case_key", "left").select("case_key", "sort_order", holds.alias("holds"))


@query("citation_extract", r"""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\[证据:\s*(knowledge:[^\]\s]+)\]', 1))), '|') AS cited, NOT contains(t, '未检索到已发布企业知识') AS claim
FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' [证据: knowledge:' || (doc_id % 7) || ':v1] [证据:knowledge:' || (doc_id % 5) || ':v1] [证据: other:1]' ELSE ' 未检索到已发布企业知识' END AS t FROM documents) q""")
def _(spark, sf):
    i = F.col("doc_id")
    marks = F.concat(
        F.lit(" [证据: knowledge:"), (i % 7).cast("string"), F.lit(":v1] [证据:knowledge:"), (i % 5).cast("string"),
        F.lit(":v1] [证据: other:1]"),
    )
    said = F.concat("text", F.when(i % 2 == 0, marks).otherwise(F.lit(" 未检索到已发布企业知识")))
    return src.table(spark, sf, "documents").select(
        "doc_id", F.array_sort(ev.citations(said)).alias("cited"), ev.makes_claim(said).alias("claim")
    )


# --- matching ------------------------------------------------------------------------------

CTES["t_matches"] = """
SELECT e.case_key, e.sort_order, e.granularity, CASE WHEN coalesce(e.requirement_key, '') = '' THEN '__solo_' || e.sort_order ELSE e.requirement_key END AS group_key,
       e.document_id, r.rank, CASE e.granularity WHEN 'DOCUMENT' THEN true WHEN 'VERSION' THEN e.version_no = r.version_no ELSE e.version_no = r.version_no AND e.chunk_id = r.chunk_id END AS exact
FROM t_evidence e JOIN t_ranked r USING (case_key, document_id)"""
CTES["t_groups"] = """
SELECT g.case_key, g.group_key, coalesce(m.r, 0) AS first_rank, coalesce(m.r <= 8, false) AS satisfied
FROM (SELECT DISTINCT case_key, CASE WHEN coalesce(requirement_key, '') = '' THEN '__solo_' || sort_order ELSE requirement_key END AS group_key FROM t_evidence) g
LEFT JOIN (SELECT case_key, group_key, min(rank) AS r FROM t_matches WHERE exact GROUP BY case_key, group_key) m USING (case_key, group_key)"""


@query("evidence_match", with_tables("SELECT case_key, sort_order::BIGINT AS sort_order, granularity, group_key, document_id, rank, exact FROM t_matches"))
def _(spark, sf):
    ranked, evidence = retrieval(spark, sf)
    return ev.evidence_match(evidence, ranked)


@query("requirement_groups", with_tables("SELECT case_key, group_key, first_rank, satisfied FROM t_groups"))
def _(spark, sf):
    ranked, evidence = retrieval(spark, sf)
    return ev.requirement_groups(evidence, ranked)


CTES["t_reordered"] = """
SELECT case_key, document_id, version_no, chunk_id, row_number() OVER (PARTITION BY case_key ORDER BY score DESC, rr, rank) AS rank FROM (
  SELECT *, 0.75::DOUBLE * (1.0 - (rr - 1)::DOUBLE / (n - 1)) + 0.25::DOUBLE * (1.0 - (rank - 1)::DOUBLE / (n - 1)) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY chunk_id % 5 = 0, chunk_id % 7 DESC, rank) AS rr, count(*) OVER (PARTITION BY case_key) AS n
    FROM t_ranked WHERE rank <= 30) q) r QUALIFY row_number() OVER (PARTITION BY case_key ORDER BY score DESC, rr, rank) <= 8"""
CTES["t_met"] = """
SELECT e.case_key, e.granularity, CASE WHEN coalesce(e.requirement_key, '') = '' THEN '__solo_' || e.sort_order ELSE e.requirement_key END AS group_key, e.document_id, r.rank,
       CASE e.granularity WHEN 'DOCUMENT' THEN true WHEN 'VERSION' THEN e.version_no = r.version_no ELSE e.version_no = r.version_no AND e.chunk_id = r.chunk_id END AS exact
FROM t_evidence e JOIN t_reordered r USING (case_key, document_id)"""


@query("case_diagnostics", with_tables("""
WITH a AS (SELECT case_key, group_key, min(rank) AS r FROM t_met WHERE exact GROUP BY case_key, group_key),
b AS (SELECT case_key, group_key, min(rank) AS r FROM t_matches WHERE exact GROUP BY case_key, group_key),
g AS (SELECT case_key, bool_and(coalesce(a.r <= 8, false)) AS ok, min(a.r) AS r_after, min(b.r) AS r_before,
        string_agg(t.group_key || '=' || coalesce(b.r, 0) || '=' || coalesce(a.r, 0) || '=' || coalesce(a.r <= 8, false), '|' ORDER BY t.group_key) AS groups
      FROM t_groups t LEFT JOIN a USING (case_key, group_key) LEFT JOIN b USING (case_key, group_key) GROUP BY case_key),
f AS (SELECT case_key, min(rank) AS fine FROM t_matches WHERE exact AND granularity IN ('CHUNK', 'VERSION') GROUP BY case_key),
d AS (SELECT case_key, count(DISTINCT document_id) AS n FROM t_met GROUP BY case_key),
l AS (SELECT case_key, string_agg(chunk_id, '|' ORDER BY rank) AS chunks FROM t_reordered GROUP BY case_key),
o AS (SELECT case_key, string_agg(document_id, '|' ORDER BY rank) AS documents FROM (SELECT case_key, document_id, min(rank) AS rank FROM t_reordered GROUP BY case_key, document_id) q GROUP BY case_key),
s AS (SELECT case_key, count(*) AS n, string_agg(sub_no || '=' || m, '|' ORDER BY sub_no) AS subs FROM (SELECT case_key, rank % 2 + 1 AS sub_no, count(*) AS m FROM t_ranked GROUP BY 1, 2) q GROUP BY case_key),
z AS (SELECT case_key, count(*) AS n FROM t_ranked GROUP BY case_key)
SELECT c.case_key, coalesce(g.r_before, 0) AS rerank_before_rank, coalesce(g.r_after, 0) AS rerank_after_rank,
       coalesce(f.fine <= 10, false) AS candidate_hit_at10, coalesce(f.fine <= 30, false) AS candidate_hit_at30, coalesce(f.fine <= 50, false) AS candidate_hit_at50,
       coalesce(z.n, 0) AS candidate_count, coalesce(o.documents, '') AS final_documents, coalesce(l.chunks, '') AS final_chunks, coalesce(g.ok, false) AS group_coverage,
       z.n IS NOT NULL AND (c.question_type <> 'CROSS_DOCUMENT' OR coalesce(d.n, 0) >= 2) AS dual_hit, coalesce(g.groups, '') AS groups, s.subs AS sub_queries
FROM t_gold c LEFT JOIN g USING (case_key) LEFT JOIN f USING (case_key) LEFT JOIN d USING (case_key) LEFT JOIN l USING (case_key)
LEFT JOIN o USING (case_key) LEFT JOIN s USING (case_key) LEFT JOIN z USING (case_key)"""))
def _(spark, sf):
    """Candidates are the nearest vectors, reordered by a relevance that leaves every fifth one unscored."""
    ranked, evidence = retrieval(spark, sf)
    c = F.col("chunk_id")
    relevance = ranked.filter(c % 5 != 0).select(
        F.col("case_key").alias("query_id"), "chunk_id", (c % 7).cast("double").alias("relevance")
    )
    pool = ranked.drop("query_id").withColumnRenamed("case_key", "query_id")
    chosen = sl.rerank_blend(pool, relevance, w=0.25).select(F.col("query_id").alias("case_key"), "chunk_id", "rank")
    final = materialize(chosen.join(ranked.select("case_key", "chunk_id", "document_id", "version_no"), ["case_key", "chunk_id"]))
    parts = ranked.select("case_key", (F.col("rank") % 2 + 1).alias("sub_no"), "chunk_id")
    rows = ev.case_diagnostics(src.gold(spark, sf), evidence, ranked, final, parts=parts)
    text = lambda x, names: F.concat_ws("=", *[x[n].cast("string") for n in names])
    return rows.withColumns(
        {
            "groups": F.transform("groups", lambda g: text(g, ["group_key", "rrf_rank", "final_rank", "satisfied"])),
            "sub_queries": F.transform("sub_queries", lambda q: text(q, ["sub_no", "candidates"])),
        }
    )


@query("group_coverage", with_tables("""
SELECT case_key, count(*) FILTER (satisfied) AS satisfied_groups, count(*) AS total_groups, bool_and(satisfied) AS all_satisfied FROM t_groups GROUP BY case_key"""))
def _(spark, sf):
    ranked, evidence = retrieval(spark, sf)
    return ev.group_coverage(ev.requirement_groups(evidence, ranked))


CTES["t_case_scores"] = """
SELECT g.case_key, g.question_type, g.should_refuse, coalesce(n.c, 0) AS evidence_count, coalesce(n.c, 0) > 0 AS has_evidence,
       coalesce(m.d <= 1, false) AS d1, coalesce(m.d <= 3, false) AS d3, coalesce(m.d <= 8, false) AS d8,
       coalesce(m.c <= 1, false) AS c1, coalesce(m.c <= 3, false) AS c3, coalesce(m.c <= 8, false) AS c8,
       m.d AS dr, m.c AS cr, coalesce(1.0::DOUBLE / m.f, 0) AS rr,
       CASE WHEN coalesce(n.c, 0) > 0 THEN coalesce(x.dcg, 0) / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, CAST(least(n.c, 8) + 1 AS BIGINT)) t(i)) ELSE 0 END AS ndcg,
       coalesce(a.ok, false) AS groups_ok, coalesce(m.docs >= 2, false) AS dual, coalesce(m.docs50 >= 2, false) AS dual50,
       CASE WHEN g.question_type IN ('CROSS_DOCUMENT', 'VERSION_CONFLICT') THEN coalesce(a.ok, false) ELSE coalesce(m.c <= 8, false) END AND coalesce(n.c, 0) > 0 AS primary_hit
FROM t_gold g LEFT JOIN (SELECT case_key, count(*) AS c FROM t_evidence GROUP BY case_key) n USING (case_key)
LEFT JOIN (SELECT case_key, min(rank) AS d, min(rank) FILTER (exact AND granularity IN ('CHUNK', 'VERSION')) AS c, min(rank) FILTER (exact) AS f,
                  count(DISTINCT document_id) FILTER (rank <= 8) AS docs, count(DISTINCT document_id) FILTER (rank <= 50) AS docs50 FROM t_matches GROUP BY case_key) m USING (case_key)
LEFT JOIN (SELECT case_key, sum(1.0 / log2(rank + 1)) AS dcg FROM (SELECT DISTINCT case_key, rank FROM t_matches WHERE exact AND rank <= 8) q GROUP BY case_key) x USING (case_key)
LEFT JOIN (SELECT case_key, bool_and(satisfied) AS ok FROM t_groups GROUP BY case_key) a USING (case_key)"""
CTES["t_answer_scores"] = """
SELECT g.case_key, coalesce(k.rf, 0) AS required_facts, coalesce(k.cf, 0) AS covered_facts, coalesce(k.fc, 0) AS forbidden_claims, coalesce(k.hf, 0) AS hit_forbidden,
       CASE WHEN coalesce(len(w.cited), 0) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(w.cited, w.retrieved)) / len(w.cited)::DOUBLE END AS citation_support,
       NOT g.should_refuse OR (NOT coalesce(w.claim, false) AND coalesce(k.hf, 0) = 0) AS refusal_compliant, coalesce(w.gate_outcome = 'ABSTAIN', false) AS abstained
FROM t_gold g LEFT JOIN (SELECT case_key, count(*) FILTER (assertion_type = 'REQUIRED_FACT') AS rf, count(*) FILTER (assertion_type = 'REQUIRED_FACT' AND holds) AS cf,
    count(*) FILTER (assertion_type = 'FORBIDDEN_CLAIM') AS fc, count(*) FILTER (assertion_type = 'FORBIDDEN_CLAIM' AND holds) AS hf FROM t_checked GROUP BY case_key) k USING (case_key)
LEFT JOIN t_answers w USING (case_key)"""


@query("retrieval_case_scores", with_tables("""
SELECT case_key, evidence_count, d1 AS document_hit_at1, d8 AS document_hit_at8, c3 AS chunk_hit_at3, c8 AS chunk_hit_at8, round(rr, 6) AS reciprocal_rank,
       round(ndcg, 6)::DOUBLE AS ndcg_at8, groups_ok AS group_coverage_at8, dual AS dual_hit_at8, primary_hit AS primary_hit_at8 FROM t_case_scores"""))
def _(spark, sf):
    ranked, evidence = retrieval(spark, sf)
    scores = ev.retrieval_case_scores(src.gold(spark, sf), evidence, ranked)
    return scores.select(
        "case_key", "evidence_count", "document_hit_at1", "document_hit_at8", "chunk_hit_at3", "chunk_hit_at8",
        "reciprocal_rank", "ndcg_at8", "group_coverage_at8", "dual_hit_at8", "primary_hit_at8",
    )


@query("answer_case_scores", with_tables("""
SELECT case_key, required_facts, covered_facts, forbidden_claims, hit_forbidden, round(citation_support, 6) AS citation_support, refusal_compliant, abstained FROM t_answer_scores"""))
def _(spark, sf):
    return ev.answer_case_scores(src.gold(spark, sf), src.assertions(spark, sf), src.answers(spark, sf))


def retrieval(spark, sf, found=None):
    """The ranked lists, written once because evidence, hits and answers all read them."""
    ranked = src.ranked_ids(spark, sf, found=found)
    ranked = materialize(ranked) if found is None else ranked
    return ranked, src.evidence(spark, sf, ranked)


def scores(spark, sf):
    ranked, evidence = retrieval(spark, sf)
    return ev.case_scores(
        src.gold(spark, sf), evidence, ranked, src.assertions(spark, sf), src.answers(spark, sf, ranked)
    )


def _share(condition: str, whole: str = "count(*) FILTER (has_evidence)") -> str:
    return f"round(CASE WHEN {whole} = 0 THEN 0 ELSE count(*) FILTER ({condition}) / ({whole})::DOUBLE END, 6)::DOUBLE"


def _sums(part: str, whole: str) -> str:
    return f"round(CASE WHEN coalesce({whole}, 0) = 0 THEN 0 ELSE {part} / ({whole})::DOUBLE END, 6)::DOUBLE"


_METRICS = f"""count(*) AS case_count, count(*) FILTER (has_evidence) AS evidence_cases,
  {_share('d1')} AS document_recall_at1, {_share('d3')} AS document_recall_at3, {_share('d8')} AS document_recall_at8,
  {_share('c1')} AS chunk_recall_at1, {_share('c3')} AS chunk_recall_at3, {_share('c8')} AS chunk_recall_at8,
  {_sums('sum(rr)', 'count(*) FILTER (has_evidence)')} AS mrr, {_sums('sum(ndcg)', 'count(*) FILTER (has_evidence)')} AS ndcg_at8,
  {_share('groups_ok')} AS evidence_coverage_at8, {_share('primary_hit')} AS primary_recall_at8,
  {_share("question_type = 'CROSS_DOCUMENT' AND dual", "count(*) FILTER (question_type = 'CROSS_DOCUMENT')")} AS cross_dual_hit_at8,
  {_sums('sum(covered_facts)', 'sum(required_facts)')} AS fact_coverage, {_sums('sum(hit_forbidden)', 'sum(forbidden_claims)')} AS forbidden_rate,
  round(coalesce(avg(citation_support), 0), 6)::DOUBLE AS citation_support,
  round(count(*) FILTER (should_refuse AND refusal_compliant) / nullif(count(*) FILTER (should_refuse), 0)::DOUBLE, 6)::DOUBLE AS refusal_compliance,
  round(count(*) FILTER (NOT should_refuse AND abstained) / nullif(count(*) FILTER (NOT should_refuse), 0)::DOUBLE, 6)::DOUBLE AS false_abstention,
  round(count(*) FILTER (should_refuse AND abstained) / nullif(count(*) FILTER (should_refuse), 0)::DOUBLE, 6)::DOUBLE AS correct_abstention"""


@query("retrieval_metrics", with_tables(f"SELECT {_METRICS} FROM t_case_scores JOIN t_answer_scores USING (case_key)"))
def _(spark, sf):
    return ev.retrieval_metrics(scores(spark, sf))


@query("metrics_by_type", with_tables(f"SELECT question_type, {_METRICS} FROM t_case_scores JOIN t_answer_scores USING (case_key) GROUP BY ROLLUP (question_type)"))
def _(spark, sf):
    return ev.metrics_by_type(scores(spark, sf))


CTES["t_sources"] = """
SELECT CASE WHEN b.rank IS NULL THEN 'lexical' WHEN a.rank IS NULL THEN 'vector' ELSE 'both' END AS source_kind
FROM t_near_half a FULL JOIN t_near_full b USING (query_id, chunk_id)"""


@query("retrieval_funnel", with_tables(f"""
SELECT {', '.join(f"{_share(f'{c} <= {k}')} AS candidate_{n}_recall_at{k}" for n, c in (('document', 'dr'), ('chunk', 'cr')) for k in (10, 30, 50))},
  {_share("question_type = 'CROSS_DOCUMENT' AND dual50", "count(*) FILTER (question_type = 'CROSS_DOCUMENT')")} AS cross_dual_hit_at50,
  (SELECT count(*) FROM t_sources WHERE source_kind = 'lexical') AS lexical_candidates, (SELECT count(*) FROM t_sources WHERE source_kind = 'vector') AS vector_candidates,
  (SELECT count(*) FROM t_sources WHERE source_kind = 'both') AS both_candidates FROM t_case_scores"""))
def _(spark, sf):
    found = materialize(src.near(spark, sf))  # its first 40 places are the full arm
    half, full = src.near(spark, sf, 40, 32), found.filter("rank <= 40")
    kinds = rt.provenance_sets(half, full).withColumnRenamed("query_id", "case_key")
    ranked, evidence = retrieval(spark, sf, found)
    return ev.retrieval_funnel(src.gold(spark, sf), evidence, ranked, kinds)


# --- answers and runs ----------------------------------------------------------------------

CTES["t_answer_cases"] = """
SELECT l.doc_id AS case_id, l.toxic = 1 AS refusal_expected, d.text AS answer, [d.text, o.text] AS required_facts,
       CASE WHEN l.doc_id % 2 = 0 THEN [o.text] ELSE [split_part(d.text, ' ', 2), o.text] END AS forbidden_claims
FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN benchmark o ON o.item_id = l.doc_id % (SELECT count(*) FROM benchmark)"""


def answer_cases(spark, sf):
    i = F.col("case_id")
    items = src.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("other"))
    rows = src.table(spark, sf, "labels").withColumnRenamed("doc_id", "case_id").join(
        src.table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("answer")), "case_id"
    ).join(items, i % F.lit(max(1, items.count())) == F.col("item_id"))
    second = F.coalesce(F.get(F.split("answer", " "), F.lit(1)), F.lit(""))
    return rows.select(
        "case_id", (F.col("toxic") == 1).alias("refusal_expected"), "answer",
        F.array("answer", "other").alias("required_facts"),
        F.when(i % 2 == 0, F.array("other")).otherwise(F.array(second, F.col("other"))).alias("forbidden_claims"),
    )


CTES["t_scored_answers"] = f"""
SELECT case_id, len(required_facts)::BIGINT AS required_count, len(list_filter(required_facts, lambda x: contains(a, {_NORMAL_KEEP.format('x')})))::BIGINT AS covered_facts,
       len(forbidden_claims)::BIGINT AS forbidden_count, len(list_filter(forbidden_claims, lambda x: contains(a, {_NORMAL_KEEP.format('x')})))::BIGINT AS hit_forbidden, refusal_expected, answer
FROM (SELECT *, {_NORMAL_KEEP.format('answer')} AS a FROM t_answer_cases) q"""
CTES["t_answer_results"] = """
SELECT case_id, required_count, covered_facts, forbidden_count, hit_forbidden, NOT refusal_expected OR (covered_facts > 0 AND hit_forbidden = 0) AS refusal_compliant,
       covered_facts > 0 AS specific, contains(answer, '[证据:') AS cited FROM t_scored_answers"""


def answer_results(spark, sf):
    rows = answer_cases(spark, sf)
    return ev.answer_score(rows.drop("answer"), rows.select("case_id", "answer"))


@query("answer_score", with_tables("SELECT case_id, required_count, covered_facts, forbidden_count, hit_forbidden, refusal_compliant, specific, cited FROM t_answer_results"))
def _(spark, sf):
    return answer_results(spark, sf)


CTES["t_run_a"] = """
SELECT *, CASE WHEN case_id % 11 = 0 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN case_id % 4 = 0 THEN 'refusal' ELSE 'fact' END AS category,
       100 + case_id % 37 AS latency_ms, case_id % 53 AS total_tokens FROM t_answer_results"""
CTES["t_run_b"] = """
SELECT case_id, category, CASE WHEN case_id % 13 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
       greatest(0, covered_facts + case_id % 3 - 1) AS covered_facts, greatest(0, hit_forbidden + case_id % 5 - 2) AS hit_forbidden,
       CASE WHEN case_id % 7 = 0 THEN NOT refusal_compliant ELSE refusal_compliant END AS refusal_compliant,
       greatest(0, covered_facts + case_id % 3 - 1) > 0 AS specific FROM t_run_a WHERE case_id % 17 <> 0"""


def run_a(spark, sf):
    i = F.col("case_id")
    return answer_results(spark, sf).withColumns(
        {
            "status": F.when(i % 11 == 0, "failed").otherwise("succeeded"),
            "category": F.when(i % 4 == 0, "refusal").otherwise("fact"),
            "latency_ms": 100 + i % 37,
            "total_tokens": i % 53,
        }
    )


def run_b(spark, sf):
    i = F.col("case_id")
    covered = F.greatest(F.lit(0), F.col("covered_facts") + i % 3 - 1)
    return run_a(spark, sf).filter(i % 17 != 0).select(
        "case_id", "category", F.when(i % 13 == 0, "failed").otherwise("succeeded").alias("status"),
        covered.alias("covered_facts"), F.greatest(F.lit(0), F.col("hit_forbidden") + i % 5 - 2).alias("hit_forbidden"),
        F.when(i % 7 == 0, ~F.col("refusal_compliant")).otherwise(F.col("refusal_compliant")).alias("refusal_compliant"),
        (covered > 0).alias("specific"),
    )


@query("gold_metrics", with_tables(f"""
WITH g AS (SELECT * FROM t_run_a WHERE status = 'succeeded')
SELECT (SELECT count(*) FROM t_run_a) AS cases, (SELECT count(*) FROM t_run_a WHERE status <> 'succeeded') AS failed, count(*) AS succeeded,
  {_sums('sum(covered_facts)', 'sum(required_count)')} AS fact_coverage_rate, {_sums('sum(hit_forbidden)', 'sum(forbidden_count)')} AS forbidden_rate,
  round(count(*) FILTER (category = 'refusal' AND refusal_compliant) / nullif(count(*) FILTER (category = 'refusal'), 0)::DOUBLE, 6)::DOUBLE AS refusal_rate,
  CAST(sum(latency_ms) AS BIGINT) AS latency_sum, CAST(sum(total_tokens) AS BIGINT) AS token_sum,
  quantile_disc(latency_ms, 0.5) AS latency_p50, quantile_disc(latency_ms, 0.95) AS latency_p95, quantile_disc(total_tokens, 0.5) AS token_p50, quantile_disc(total_tokens, 0.95) AS token_p95,
  {_share('specific', 'count(*)')} AS specific_rate, {_share('cited', 'count(*)')} AS citation_rate FROM g"""))
def _(spark, sf):
    return ev.gold_metrics(run_a(spark, sf))


@query("legacy_rag_metrics", with_tables("""
WITH c AS (SELECT 'dev-' || vec_id AS case_key, ['knowledge:' || (vec_id // 8) || ':', 'knowledge:' || (vec_id // 8 + 1) || ':v1:', 'knowledge:' || vec_id || ':'] AS expected FROM embeddings),
j AS (SELECT c.case_key, expected, retrieved, cited, claim, len(list_filter(expected, lambda p: len(list_filter(retrieved, lambda r: starts_with(r, p))) > 0)) AS met,
             len(list_intersect(cited, retrieved)) AS good FROM c JOIN t_answers USING (case_key))
SELECT round(sum(met) / sum(len(expected))::DOUBLE, 6)::DOUBLE AS retrieval_recall, round(sum(good) / sum(len(cited))::DOUBLE, 6)::DOUBLE AS citation_correctness,
       round(count(*) FILTER (claim AND (len(cited) = 0 OR good <> len(cited))) / count(*)::DOUBLE, 6)::DOUBLE AS ungrounded_rate, count(*) AS case_count FROM j"""))
def _(spark, sf):
    i = F.col("vec_id")
    name = lambda d, tail: F.concat(F.lit("knowledge:"), d.cast("string"), F.lit(tail))
    cases = src.table(spark, sf, "embeddings").select(
        F.concat(F.lit("dev-"), i.cast("string")).alias("case_key"),
        F.array(name(F.floor(i / 8), ":"), name(F.floor(i / 8) + 1, ":v1:"), name(i, ":")).alias("expected"),
    )
    return ev.legacy_metrics(cases, src.answers(spark, sf).drop("answer"))


@query("retry_merge", with_tables("""
SELECT 'dev-' || a.case_id AS case_key, 'v1' AS dataset_version, CASE WHEN a.status <> 'succeeded' AND b.case_id IS NOT NULL THEN b.status ELSE a.status END AS status,
       CASE WHEN a.status <> 'succeeded' AND b.case_id IS NOT NULL THEN b.covered_facts ELSE a.covered_facts END AS score, NOT (a.status <> 'succeeded' AND b.case_id IS NOT NULL) AS carried
FROM t_run_a a LEFT JOIN t_run_b b USING (case_id)"""))
def _(spark, sf):
    shown = lambda df: df.select(
        F.concat(F.lit("dev-"), F.col("case_id").cast("string")).alias("case_key"), F.lit("v1").alias("dataset_version"),
        "status", F.col("covered_facts").alias("score"),
    )
    return ev.retry_merge(shown(run_a(spark, sf)), shown(run_b(spark, sf)))


@query("case_delta", with_tables("""
WITH j AS (SELECT a.case_id, a.category, b.case_id IS NULL AS missing, b.covered_facts - a.covered_facts AS f, b.hit_forbidden - a.hit_forbidden AS h,
  a.refusal_compliant AS ra, b.refusal_compliant AS rb, a.specific AS sa, b.specific AS sb, a.status AS ta, b.status AS tb FROM t_run_a a LEFT JOIN t_run_b b USING (case_id)),
k AS (SELECT *, f > 0 OR h < 0 OR (NOT ra AND rb) OR (NOT sa AND sb) OR (ta = 'failed' AND tb = 'succeeded') AS better,
  f < 0 OR h > 0 OR (ra AND NOT rb) OR (sa AND NOT sb) OR (ta = 'succeeded' AND tb = 'failed') AS worse FROM j)
SELECT case_id, category, CASE WHEN missing THEN 'missing' WHEN better AND worse THEN 'mixed' WHEN better THEN 'improved' WHEN worse THEN 'regressed' ELSE 'unchanged' END AS change,
       f AS fact_delta, h AS forbidden_delta, CASE WHEN ra <> rb THEN rb END AS refusal_now, CASE WHEN sa <> sb THEN sb END AS specific_now FROM k"""))
def _(spark, sf):
    return ev.case_delta(run_a(spark, sf), run_b(spark, sf))


_GATE_METRICS = ["document_recall_at8", "chunk_recall_at8", "evidence_coverage_at8", "fact_coverage", "forbidden_rate", "refusal_compliance", "false_abstention", "citation_support"]
_GATE_SELECT = f"{_METRICS}, 0 AS failed_cases"
_GATE_RULES = [
    ("document_recall_at8_regressed", "c.document_recall_at8 < b.document_recall_at8 - 0.02"), ("chunk_recall_at8_regressed", "c.chunk_recall_at8 < b.chunk_recall_at8 - 0.02"),
    ("final_evidence_coverage_at8_regressed", "c.evidence_coverage_at8 < b.evidence_coverage_at8 - 0.02"), ("required_fact_coverage_regressed", "c.fact_coverage < b.fact_coverage - 0.02"),
    ("forbidden_claim_rate_regressed", "c.forbidden_rate > b.forbidden_rate + 0.01"), ("should_refuse_compliance_regressed", "c.refusal_compliance < b.refusal_compliance - 0.02"),
    ("false_abstention_rate_regressed", "c.false_abstention > b.false_abstention + 0.02"), ("citation_support_rate_regressed", "c.citation_support < b.citation_support - 0.02"),
]
_VIOLATIONS = " || ".join(f"CASE WHEN {rule} THEN '|{name}' ELSE '' END" for name, rule in _GATE_RULES)


# Every question type is gated against the overall row.
@query("regression_gate", with_tables(f"""
WITH m AS (SELECT question_type, {_METRICS} FROM t_case_scores JOIN t_answer_scores USING (case_key) GROUP BY ROLLUP (question_type)),
v AS (SELECT c.question_type AS dataset_key, CASE WHEN c.question_type = 'REFUSAL' THEN '|dataset_checksum_mismatch' ELSE {_VIOLATIONS} END AS t
      FROM m b JOIN m c ON b.question_type IS NULL AND c.question_type IS NOT NULL)
SELECT dataset_key, ltrim(t, '|') AS violations, t = '' AS passed FROM v"""))
def _(spark, sf):
    rows = ev.metrics_by_type(scores(spark, sf)).withColumn("failed_cases", F.lit(0))
    # A row per type, read three times.
    rounded = materialize(rows.select("question_type", "failed_cases", *[F.round(c, 6).alias(c) for c in _GATE_METRICS]))
    overall = rounded.filter("question_type IS NULL").drop("question_type").withColumn("checksum", F.lit("a"))
    one = F.lit(1)
    typed = rounded.filter("question_type IS NOT NULL").withColumn("_one", one)
    named = typed.select("question_type", "_one").join(overall.withColumn("_one", one), "_one").drop("_one")
    base = named.withColumnRenamed("question_type", "dataset_key")
    mark = F.when(F.col("question_type") == "REFUSAL", "b").otherwise("a")
    candidate = typed.drop("_one").withColumn("checksum", mark).withColumnRenamed("question_type", "dataset_key")
    return ev.regression_gate(base, candidate)


CTES["t_movement"] = """
SELECT o_orderkey AS id, o_orderkey % 30 AS before_rank, o_custkey % 13 AS after_rank, o_orderkey % 19 = 0 AS fallback, CASE WHEN o_orderkey % 23 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS latency_ms,
       CASE WHEN o_custkey % 5 = 0 THEN 'rrf' ELSE 'cross-encoder' END AS reranker FROM orders"""


@query("rerank_movement", with_tables("""
SELECT count(*) FILTER (ok AND before_rank > 8 AND after_rank BETWEEN 1 AND 8) AS gained, count(*) FILTER (ok AND before_rank BETWEEN 1 AND 8 AND after_rank = 0) AS lost,
       count(*) FILTER (ok AND before_rank > 0 AND (after_rank = 0 OR after_rank > before_rank)) AS demoted,
       round(count(*) FILTER (latency_ms IS NOT NULL AND fallback) / count(latency_ms)::DOUBLE, 6)::DOUBLE AS fallback_rate,
       quantile_disc(latency_ms, 0.5) AS latency_p50, quantile_disc(latency_ms, 0.95) AS latency_p95
FROM (SELECT *, NOT fallback AND reranker = 'cross-encoder' AS ok FROM t_movement) q"""))
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = src.table(spark, sf, "orders").select(
        (k % 30).alias("before_rank"), (c % 13).alias("after_rank"), (k % 19 == 0).alias("fallback"),
        F.when(k % 23 != 0, F.floor("o_totalprice")).alias("latency_ms"),
        F.when(c % 5 == 0, "rrf").otherwise("cross-encoder").alias("reranker"),
    )
    return ev.rerank_movement(rows)


@query("variant_compare", with_tables("""
WITH v AS (SELECT s.case_key, s.question_type, s.c8 AS hit, s.dual, v.variant, CASE v.variant WHEN 'rrf0' THEN s.c3 WHEN 'fusion' THEN s.d8 ELSE s.cr <= 20 END AS vh, s.dual50 AS vd
           FROM t_case_scores s, (VALUES ('rrf0'), ('fusion'), ('div')) v(variant)),
w AS (SELECT *, coalesce(vh, false) AS h2 FROM v)
SELECT variant, count(*) AS cases, count(*) FILTER (hit) AS baseline_hits, count(*) FILTER (h2) AS variant_hits, count(*) FILTER (NOT hit AND h2) AS gained, count(*) FILTER (hit AND NOT h2) AS lost,
       count(*) FILTER (hit AND h2) AS stay_hit, count(*) FILTER (NOT hit AND NOT h2) AS stay_miss, count(*) FILTER (question_type = 'CROSS_DOCUMENT' AND dual) AS baseline_dual,
       count(*) FILTER (question_type = 'CROSS_DOCUMENT' AND vd) AS variant_dual, count(*) FILTER (question_type = 'CROSS_DOCUMENT') AS cross_cases FROM w GROUP BY variant"""))
def _(spark, sf):
    ranked, evidence = retrieval(spark, sf)
    rows = ev.retrieval_case_scores(src.gold(spark, sf), evidence, ranked)
    wide = ev.evidence_match(evidence, ranked).groupBy("case_key").agg(
        (F.count_distinct("document_id") >= 2).alias("dual50")
    )
    rows = rows.join(wide, "case_key", "left")
    base = rows.select("case_key", "question_type", F.col("chunk_hit_at8").alias("hit"), F.col("dual_hit_at8").alias("dual_hit"))
    dual = F.coalesce("dual50", F.lit(False)).alias("dual_hit")
    late = F.coalesce(F.col("chunk_rank") <= 20, F.lit(False))
    options = F.array(
        *[
            F.struct(F.lit(n).alias("variant"), h.alias("hit"))
            for n, h in (("rrf0", F.col("chunk_hit_at3")), ("fusion", F.col("document_hit_at8")), ("div", late))
        ]
    )
    variants = rows.select("case_key", dual, F.inline(options))
    return ev.variant_compare(base, variants)


CTES["t_probe"] = "SELECT case_key, question_type, cr <= 50 AS hit50, c8, cr FROM t_case_scores WHERE has_evidence"


@query("hard_case_mining", with_tables("""
WITH n AS (SELECT * FROM t_probe WHERE hit50 AND NOT c8 AND cr BETWEEN 9 AND 20),
q AS (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY cr, case_key) AS r,
   CASE question_type WHEN 'SINGLE_DOCUMENT_FACT' THEN 8 WHEN 'CROSS_DOCUMENT' THEN 4 WHEN 'VERSION_CONFLICT' THEN 2 WHEN 'OPERATION_PROCESS' THEN 1 ELSE 0 END AS a,
   CASE question_type WHEN 'SINGLE_DOCUMENT_FACT' THEN 0 WHEN 'CROSS_DOCUMENT' THEN 1 WHEN 'VERSION_CONFLICT' THEN 2 WHEN 'OPERATION_PROCESS' THEN 3 END AS p FROM n)
SELECT case_key, question_type, cr AS gold_rank, r > a AS filled FROM q WHERE r <= a OR question_type = 'SINGLE_DOCUMENT_FACT' ORDER BY r > a, p, cr, case_key LIMIT 15"""))
def _(spark, sf):
    ranked, evidence = retrieval(spark, sf)
    rows = ev.retrieval_case_scores(src.gold(spark, sf), evidence, ranked).filter("has_evidence")
    return ev.hard_case_mining(
        rows.select(
            "case_key", "question_type", F.coalesce(F.col("chunk_rank") <= 50, F.lit(False)).alias("candidate_hit_at50"),
            "chunk_hit_at8", F.coalesce("chunk_rank", F.lit(0)).alias("gold_rank"),
        )
    )


# --- datasets ------------------------------------------------------------------------------


@query("case_slice", with_tables("SELECT case_key, question_type FROM t_gold WHERE vec_id IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0)"))
def _(spark, sf):
    i = F.col("doc_id")
    mark = F.when(i % 3 == 0, "# dev-").otherwise(" dev-")
    keys = src.table(spark, sf, "labels").select(F.concat(mark, i.cast("string"), F.lit(" ")).alias("value"))
    return ev.case_slice(src.gold(spark, sf), keys).select("case_key", "question_type")


_TYPE_VALUES = ", ".join(f"('{t}')" for t in [*ev.QUESTION_TYPES, "OTHER"])


@query("case_histogram", with_tables(f"""
SELECT v.t AS question_type, (SELECT count(*) FROM t_gold g WHERE g.question_type = v.t) AS cases FROM (VALUES {_TYPE_VALUES}) v(t)"""))
def _(spark, sf):
    return ev.case_histogram(src.gold(spark, sf), "question_type", [*ev.QUESTION_TYPES, "OTHER"])


CTES["t_dataset"] = """
SELECT DISTINCT 'ds-' || label AS dataset_key, CASE WHEN label % 4 = 3 THEN '' ELSE 'v' || label END AS dataset_version,
       CASE label % 3 WHEN 0 THEN 'DEVELOPMENT' WHEN 1 THEN 'VALIDATION' ELSE 'OTHER' END AS split, 'corpus-1' AS corpus_version, label AS ws FROM embeddings"""


def dataset(spark, sf):
    n = F.col("label")
    return src.table(spark, sf, "embeddings").select("label").distinct().select(
        F.concat(F.lit("ds-"), n.cast("string")).alias("dataset_key"),
        F.when(n % 4 == 3, "").otherwise(F.concat(F.lit("v"), n.cast("string"))).alias("dataset_version"),
        F.when(n % 3 == 0, "DEVELOPMENT").when(n % 3 == 1, "VALIDATION").otherwise("OTHER").alias("split"),
        F.lit("corpus-1").alias("corpus_version"), n.alias("ws"),
    )


@query("dataset_snapshot", with_tables("""
SELECT g.case_key, d.split, coalesce(e.evidences, '') AS evidences, coalesce(a.assertions, '') AS assertions FROM t_gold g JOIN t_dataset d USING (dataset_key)
LEFT JOIN (SELECT case_key, string_agg(sort_order || ':' || granularity || ':' || document_id, '|' ORDER BY sort_order) AS evidences FROM t_evidence GROUP BY case_key) e USING (case_key)
LEFT JOIN (SELECT case_key, string_agg(sort_order || ':' || assertion_type, '|' ORDER BY sort_order) AS assertions FROM t_assertions GROUP BY case_key) a USING (case_key)"""))
def _(spark, sf):
    rows = ev.dataset_snapshot(dataset(spark, sf), src.gold(spark, sf), src.evidence(spark, sf), src.assertions(spark, sf))
    none = F.array().cast("array<string>")
    text = lambda *cs: F.concat_ws(":", *[c.cast("string") for c in cs])
    return rows.select(
        "case_key", "split",
        F.coalesce(F.transform("evidences", lambda e: text(e["sort_order"], e["granularity"], e["document_id"])), none).alias("evidences"),
        F.coalesce(F.transform("assertions", lambda a: text(a["sort_order"], a["assertion_type"])), none).alias("assertions"),
    )


@query("dataset_checksum", with_tables("""
WITH c AS (SELECT dataset_key, string_agg('case:' || case_key || '|' || question_text || '|' || question_type || '|' || difficulty || '|' || should_refuse::VARCHAR || chr(10), '' ORDER BY case_key) AS t FROM t_gold GROUP BY dataset_key),
e AS (SELECT g.dataset_key, string_agg('evidence:' || e.case_key || '|' || granularity || '|' || document_id || '|' || version_no || '|' || coalesce(chunk_id::VARCHAR, 'null') || '|' || requirement_key || chr(10), '' ORDER BY e.case_key, e.sort_order) AS t
      FROM t_evidence e JOIN t_gold g USING (case_key) GROUP BY g.dataset_key),
a AS (SELECT g.dataset_key, string_agg('assertion:' || a.case_key || '|' || assertion_type || '|' || assertion_text || '|' || weight || chr(10), '' ORDER BY a.case_key, a.sort_order) AS t
      FROM t_assertions a JOIN t_gold g USING (case_key) GROUP BY g.dataset_key)
SELECT dataset_key, sha256(dataset_key || '|' || dataset_version || '|' || split || '|' || corpus_version || chr(10) || coalesce(c.t, '') || coalesce(e.t, '') || coalesce(a.t, '')) AS checksum
FROM t_dataset LEFT JOIN c USING (dataset_key) LEFT JOIN e USING (dataset_key) LEFT JOIN a USING (dataset_key)"""))
def _(spark, sf):
    return ev.dataset_checksum(dataset(spark, sf), src.gold(spark, sf), src.evidence(spark, sf), src.assertions(spark, sf))


CTES["t_turns"] = """
SELECT 'dev-' || conv_id AS case_key, role, CASE WHEN conv_id % 9 = 0 THEN ' ' ELSE text END AS content FROM conversations"""


@query("gold_data_quality", with_tables("""
WITH e AS (SELECT case_key, count(*) AS n FROM t_evidence GROUP BY case_key),
a AS (SELECT case_key, count(*) AS n, count(*) FILTER (weight <= 0) AS w, count(*) FILTER (assertion_type = 'REQUIRED_FACT') AS r, count(*) FILTER (assertion_type = 'FORBIDDEN_CLAIM') AS f FROM t_assertions GROUP BY case_key),
t AS (SELECT case_key, count(*) AS n, count(*) FILTER (role NOT IN ('user', 'assistant')) AS r, count(*) FILTER (trim(content) = '') AS b FROM t_turns GROUP BY case_key),
j AS (SELECT g.*, d.split, coalesce(e.n, 0) AS en, coalesce(a.n, 0) AS an, coalesce(a.w, 0) AS aw, coalesce(a.r, 0) AS ar, coalesce(a.f, 0) AS af, coalesce(t.n, 0) AS tn, coalesce(t.r, 0) AS tr, coalesce(t.b, 0) AS tb
  FROM t_gold g JOIN t_dataset d USING (dataset_key) LEFT JOIN e USING (case_key) LEFT JOIN a USING (case_key) LEFT JOIN t USING (case_key))
SELECT dataset_key AS case_key, 'missing_dataset_version' AS rule FROM t_dataset WHERE dataset_version = ''
UNION ALL SELECT dataset_key, 'bad_split' FROM t_dataset WHERE split = 'OTHER'
UNION ALL SELECT case_key, 'bad_case_key_prefix' FROM j WHERE split = 'VALIDATION'
UNION ALL SELECT case_key, 'bad_reviewer' FROM j WHERE reviewer <> 'reviewer3'
UNION ALL SELECT case_key, 'missing_evidence' FROM j WHERE question_type NOT IN ('CHITCHAT', 'NO_ANSWER') AND en = 0
UNION ALL SELECT case_key, 'too_many_turns' FROM j WHERE tn > 6
UNION ALL SELECT case_key, 'bad_turn_role' FROM j WHERE tr > 0
UNION ALL SELECT case_key, 'blank_turn' FROM j WHERE tb > 0
UNION ALL SELECT case_key, 'too_few_assertions' FROM j WHERE an < 2
UNION ALL SELECT case_key, 'bad_weight' FROM j WHERE aw > 0
UNION ALL SELECT case_key, 'missing_required_fact' FROM j WHERE ar = 0
UNION ALL SELECT case_key, 'missing_forbidden_claim' FROM j WHERE af = 0"""))
def _(spark, sf):
    i = F.col("conv_id")
    turns = src.table(spark, sf, "conversations").select(
        F.concat(F.lit("dev-"), i.cast("string")).alias("case_key"), "role",
        F.when(i % 9 == 0, " ").otherwise(F.col("text")).alias("content"),
    )
    return ev.gold_data_quality(
        dataset(spark, sf), src.gold(spark, sf), src.evidence(spark, sf), src.assertions(spark, sf), turns, "reviewer3"
    )


@query("evidence_resolution", with_tables("""
SELECT w.doc_id, w.version_no, w.chunk_no, c.chunk_id, c.chunk_id IS NOT NULL AS resolved
FROM (SELECT doc_id, 1 + doc_id % 3 AS version_no, (1 + quality)::BIGINT AS chunk_no FROM labels) w
LEFT JOIN t_chunks c ON c.document_id = w.doc_id AND c.version_no = w.version_no AND c.chunk_no = w.chunk_no"""))
def _(spark, sf):
    i = F.col("doc_id")
    wanted = src.table(spark, sf, "labels").select(
        F.concat(F.lit("doc-"), i.cast("string")).alias("document_ref"), i.alias("doc_id"),
        (1 + i % 3).alias("version_no"), (1 + F.col("quality")).cast("bigint").alias("chunk_no"),
    )
    manifest = src.chunks(spark, sf).select(
        F.concat(F.lit("doc-"), F.col("document_id").cast("string")).alias("document_ref"),
        "version_no", "chunk_no", "document_id", "chunk_id",
    )
    good, bad = ev.evidence_resolution(wanted, manifest)
    shown = ["doc_id", "version_no", "chunk_no"]
    return good.select(*shown, "chunk_id", F.lit(True).alias("resolved")).unionByName(
        bad.select(*shown, F.lit(None).cast("bigint").alias("chunk_id"), F.lit(False).alias("resolved"))
    )


@query("ablation_summary", """
WITH r AS (SELECT o_orderpriority AS variant, o_orderstatus AS slice, o_orderkey AS run_id, o_orderdate AS created_at, round(o_totalprice / 500000.0, 3) AS recall,
                  CASE WHEN o_custkey % 2 = 0 THEN (o_custkey % 1000) / 1000.0::DOUBLE END AS cov, 'sum' || o_custkey AS checksum FROM orders),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, slice ORDER BY created_at DESC, run_id DESC) AS k FROM r) q WHERE k = 1)
SELECT variant, slice, printf('%.1f', round(recall * 100, 1)) || '%' AS recall, coalesce(printf('%.1f', round(cov * 100, 1)) || '%', '-') AS cov, checksum FROM n""")
def _(spark, sf):
    c = F.col("o_custkey")
    runs = src.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("variant"), F.col("o_orderstatus").alias("slice"), F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("created_at"), F.round(F.col("o_totalprice") / 500000.0, 3).alias("recall"),
        F.when(c % 2 == 0, (c % 1000) / 1000.0).alias("cov"), F.concat(F.lit("sum"), c.cast("string")).alias("checksum"),
    )
    return ev.ablation_summary(runs, ["recall", "cov"])


@query("gold_subqueries")
def _(spark, sf):
    return rt.gold_subqueries(
        src.gold(spark, sf).withColumn("question_text", F.concat("question_text", F.lit("，外挂举报和暑期签到的处理流程是什么？"))),
        src.evidence(spark, sf), src.docs(spark, sf),
    )
