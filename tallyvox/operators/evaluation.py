"""Scoring of retrieval and answers against gold datasets, comparisons and gates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.text import answer_normalize, assertion_match, is_blank
from tallyvox.operators.dashboard import ranked

# Dataset vocabulary.
SPLITS = {"DEVELOPMENT": "dev-", "VALIDATION": "val-", "FROZEN": "frozen-"}
QUESTION_TYPES = [
    "SINGLE_DOCUMENT_FACT", "CROSS_DOCUMENT", "VERSION_CONFLICT", "WORKSPACE_BOUNDARY",
    "OPERATION_PROCESS", "REFUSAL", "CHITCHAT", "NO_ANSWER",
]
DIFFICULTIES = ["EASY", "MEDIUM", "HARD"]
ABSTAIN_TYPES = ["REFUSAL", "CHITCHAT", "NO_ANSWER"]
EMPTY_EVIDENCE_TYPES = ["CHITCHAT", "NO_ANSWER"]
GROUP_PRIMARY_TYPES = ["CROSS_DOCUMENT", "VERSION_CONFLICT"]
GRANULARITIES = ["DOCUMENT", "VERSION", "CHUNK"]
ASSERTION_TYPES = ["REQUIRED_FACT", "FORBIDDEN_CLAIM"]
TURN_ROLES = ["user", "assistant"]
MAX_CONTEXT_TURNS = 6

# Citation marks and gate tolerances.
CITATION_PATTERN = r"\[证据:\s*(knowledge:[^\]\s]+)\]"
CITATION_MARK = "[证据:"
NO_KNOWLEDGE = "未检索到已发布企业知识"
MAX_DROP = 0.02
MAX_FORBIDDEN_RISE = 0.01
MAX_ABSTENTION_RISE = 0.02
TOP = 8


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)))


def _ratio_or_null(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def _share(condition: Column, whole: Column) -> Column:
    return _ratio(F.count_if(condition), whole)


def citations(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CITATION_PATTERN), F.lit(1))
    return F.array_distinct(found)


def makes_claim(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).contains(NO_KNOWLEDGE)


# --- evidence matching ---------------------------------------------------------------------


def evidence_match(evidence: DataFrame, ranked_list: DataFrame) -> DataFrame:
    """Evidence met by ranked results: every document-level meeting, `exact` at its own level.

    One equi-join on (case, document) serves all three granularities.
    """
    hits = ranked_list.select(
        "case_key",
        "document_id",
        "rank",
        F.col("version_no").alias("_v"),
        F.col("chunk_id").alias("_c"),
    )
    same_version = F.col("version_no") == F.col("_v")
    exact = (
        (F.col("granularity") == "DOCUMENT")
        | ((F.col("granularity") == "VERSION") & same_version)
        | ((F.col("granularity") == "CHUNK") & same_version & (F.col("chunk_id") == F.col("_c")))
    )
    return evidence.join(hits, ["case_key", "document_id"]).select(
        "case_key",
        "sort_order",
        "granularity",
        group_key().alias("group_key"),
        "document_id",
        "rank",
        F.coalesce(exact, F.lit(False)).alias("exact"),
    )


def group_key() -> Column:
    """Evidence without a requirement key forms a group of its own."""
    solo = F.concat(F.lit("__solo_"), F.col("sort_order").cast("string"))
    return F.when(is_blank(F.col("requirement_key")), solo).otherwise(F.col("requirement_key"))


def requirement_groups(evidence: DataFrame, ranked_list: DataFrame, k: int = TOP) -> DataFrame:
    """Per case and group the first exact rank (0 when none) and whether it lies within k."""
    groups = evidence.select("case_key", group_key().alias("group_key")).distinct()
    first = (
        evidence_match(evidence, ranked_list)
        .filter("exact")
        .groupBy("case_key", "group_key")
        .agg(F.min("rank").alias("_rank"))
    )
    return groups.join(first, ["case_key", "group_key"], "left").select(
        "case_key",
        "group_key",
        F.coalesce("_rank", F.lit(0)).alias("first_rank"),
        F.coalesce(F.col("_rank") <= k, F.lit(False)).alias("satisfied"),
    )


def case_diagnostics(
    cases: DataFrame,
    evidence: DataFrame,
    candidates: DataFrame,
    final: DataFrame,
    gate: DataFrame | None = None,
    parts: DataFrame | None = None,
    k: int = TOP,
) -> DataFrame:
    """Where retrieval and rerank placed the evidence of every case, as a whole and per requirement group.

    `candidates` and `final` are ranked lists before and after the rerank. Ranks are those of the first
    exact meeting, 0 where there is none; hits at 10, 30 and 50 count evidence finer than a document.
    `gate(case_key, outcome, top_score, input_count, injected_count)` is added as it is; a case without
    one injects nothing. `parts(case_key, sub_no, chunk_id)` gives the candidates per sub-query. Cases
    without evidence have no groups and cover nothing; two documents are asked of cross-document cases
    only, and of none without any list.
    """
    unmet = evidence.select(
        "case_key", "granularity", group_key().alias("group_key"), "document_id",
        F.lit(None).cast("int").alias("rank"), F.lit(False).alias("exact"), F.lit(False).alias("_final"),
    )
    before = evidence_match(evidence, candidates).drop("sort_order").withColumn("_final", F.lit(False))
    after = evidence_match(evidence, final).drop("sort_order").withColumn("_final", F.lit(True))
    rank, exact, last = F.col("rank"), F.col("exact"), F.col("_final")
    fine = exact & F.col("granularity").isin("CHUNK", "VERSION")
    groups = (
        unmet.unionByName(before)
        .unionByName(after)
        .groupBy("case_key", "group_key")
        .agg(
            F.min(F.when(exact & ~last, rank)).alias("_before"),
            F.min(F.when(exact & last, rank)).alias("_after"),
            F.min(F.when(fine & ~last, rank)).alias("_fine"),
            F.collect_set(F.when(last & (rank <= k), F.col("document_id"))).alias("_documents"),
        )
    )
    satisfied = F.coalesce(F.col("_after") <= k, F.lit(False))
    shown = F.struct(
        "group_key",
        F.coalesce("_before", F.lit(0)).alias("rrf_rank"),
        F.coalesce("_after", F.lit(0)).alias("final_rank"),
        satisfied.alias("satisfied"),
    )
    met = groups.groupBy("case_key").agg(
        F.min("_before").alias("_before"),
        F.min("_after").alias("_after"),
        F.min("_fine").alias("_fine"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_documents")))).alias("_documents"),
        F.bool_and(satisfied).alias("_covered"),
        F.array_sort(F.collect_list(shown)).alias("groups"),
    )
    sizes = candidates.groupBy("case_key").agg(F.count(F.lit(1)).alias("candidate_count"))
    lists = final.groupBy("case_key").agg(
        F.array_sort(F.collect_list(F.struct("rank", "document_id", "chunk_id"))).alias("_final")
    )
    rows = cases.select("case_key", "question_type")
    for part in (met, sizes, lists):
        rows = rows.join(part, "case_key", "left")
    listed = F.col("candidate_count").isNotNull() | F.col("_final").isNotNull()
    ids = F.coalesce("_final", F.array().cast(lists.schema["_final"].dataType))
    none = F.array().cast(met.schema["groups"].dataType)
    result = rows.select(
        "case_key",
        F.coalesce("_before", F.lit(0)).alias("rerank_before_rank"),
        F.coalesce("_after", F.lit(0)).alias("rerank_after_rank"),
        *[F.coalesce(F.col("_fine") <= n, F.lit(False)).alias(f"candidate_hit_at{n}") for n in (10, 30, 50)],
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.array_distinct(F.transform(ids, lambda x: x["document_id"])).alias("final_documents"),
        F.transform(ids, lambda x: x["chunk_id"]).alias("final_chunks"),
        F.coalesce("_covered", F.lit(False)).alias("group_coverage"),
        (listed & ((F.col("question_type") != "CROSS_DOCUMENT") | (F.coalesce("_documents", F.lit(0)) >= 2))).alias("dual_hit"),
        F.coalesce("groups", none).alias("groups"),
    )
    if parts is not None:
        counted = parts.groupBy("case_key", "sub_no").agg(F.count("chunk_id").alias("candidates"))
        per_case = counted.groupBy("case_key").agg(
            F.array_sort(F.collect_list(F.struct("sub_no", "candidates"))).alias("sub_queries")
        )
        result = result.join(per_case, "case_key", "left")
    if gate is not None:
        decisions = gate.select(
            "case_key",
            F.col("outcome").alias("gate_outcome"),
            F.col("top_score").alias("gate_top_score"),
            F.col("input_count").alias("gate_input_count"),
            F.col("injected_count").alias("gate_injected_count"),
        )
        result = result.join(decisions, "case_key", "left").fillna(
            {"gate_outcome": "INJECT", "gate_top_score": 0.0, "gate_input_count": 0, "gate_injected_count": 0}
        )
    return result


def group_coverage(groups: DataFrame) -> DataFrame:
    return groups.groupBy("case_key").agg(
        F.count_if(F.col("satisfied")).alias("satisfied_groups"),
        F.count(F.lit(1)).alias("total_groups"),
        F.bool_and("satisfied").alias("all_satisfied"),
    )


def _discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def retrieval_case_scores(cases: DataFrame, evidence: DataFrame, ranked_list: DataFrame) -> DataFrame:
    """Hits, reciprocal rank, nDCG and requirement coverage of every case."""
    matched = evidence_match(evidence, ranked_list)
    fine = F.col("exact") & F.col("granularity").isin("CHUNK", "VERSION")
    per_case = matched.groupBy("case_key").agg(
        F.min("rank").alias("document_rank"),
        F.min(F.when(fine, F.col("rank"))).alias("chunk_rank"),
        F.min(F.when(F.col("exact"), F.col("rank"))).alias("first_rank"),
        F.array_sort(
            F.collect_set(F.when(F.col("exact") & (F.col("rank") <= TOP), F.col("rank")))
        ).alias("hit_ranks"),
        F.count_distinct(F.when(F.col("rank") <= TOP, F.col("document_id"))).alias("documents_hit"),
    )
    expected = evidence.groupBy("case_key").agg(F.count(F.lit(1)).alias("evidence_count"))
    covered = group_coverage(requirement_groups(evidence, ranked_list)).select(
        "case_key", "all_satisfied"
    )
    add = lambda acc, r: acc + _discount(r)
    dcg = F.aggregate(F.coalesce("hit_ranks", F.array().cast("array<int>")), F.lit(0.0), add)
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("evidence_count"), F.lit(TOP))).cast("int")),
        F.lit(0.0),
        add,
    )
    within = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    return (
        cases.join(expected, "case_key", "left")
        .join(per_case, "case_key", "left")
        .join(covered, "case_key", "left")
        .withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
        .withColumns(
            {
                "has_evidence": F.col("evidence_count") > 0,
                **{f"document_hit_at{k}": within("document_rank", k) for k in (1, 3, 8)},
                **{f"chunk_hit_at{k}": within("chunk_rank", k) for k in (1, 3, 8)},
                "reciprocal_rank": F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)),
                "ndcg_at8": F.when(F.col("evidence_count") > 0, dcg / ideal).otherwise(F.lit(0.0)),
                "group_coverage_at8": F.coalesce("all_satisfied", F.lit(False)),
                "dual_hit_at8": F.coalesce(F.col("documents_hit") >= 2, F.lit(False)),
            }
        )
        .withColumn(
            "primary_hit_at8",
            F.when(F.col("question_type").isin(GROUP_PRIMARY_TYPES), F.col("group_coverage_at8"))
            .otherwise(F.col("chunk_hit_at8"))
            & F.col("has_evidence"),
        )
        .drop("hit_ranks", "all_satisfied", "documents_hit")
    )


def answer_case_scores(cases: DataFrame, assertions: DataFrame, answers: DataFrame) -> DataFrame:
    """Facts, forbidden claims, citation support, refusal and abstention of every case.

    `answers(case_key, answer, cited, retrieved, claim, gate_outcome)`.
    """
    said = answers.select("case_key", answer_normalize(F.col("answer")).alias("_answer"))
    claims = assertions.withColumn("_claim", answer_normalize(F.col("assertion_text")))
    checked = (
        claims.join(said, "case_key", "left")
        .withColumn("_answer", F.coalesce("_answer", F.lit("")))
        .withColumn("_holds", assertion_match(F.col("_answer"), F.col("_claim")))
    )
    required, forbidden = (F.col("assertion_type") == t for t in ASSERTION_TYPES)
    counted = checked.groupBy("case_key").agg(
        F.count_if(required).alias("required_facts"),
        F.count_if(required & F.col("_holds")).alias("covered_facts"),
        F.count_if(forbidden).alias("forbidden_claims"),
        F.count_if(forbidden & F.col("_holds")).alias("hit_forbidden"),
    )
    cited = F.size("cited")
    support = F.when(F.coalesce(cited, F.lit(0)) <= 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect("cited", "retrieved")) / cited
    )
    counts = ["required_facts", "covered_facts", "forbidden_claims", "hit_forbidden"]
    return (
        cases.select("case_key", "should_refuse")
        .join(counted, "case_key", "left")
        .join(answers.drop("answer"), "case_key", "left")
        .fillna(0, counts)
        .select(
            "case_key",
            *counts,
            support.alias("citation_support"),
            (
                ~F.col("should_refuse")
                | (~F.coalesce("claim", F.lit(False)) & (F.col("hit_forbidden") == 0))
            ).alias("refusal_compliant"),
            F.coalesce(F.col("gate_outcome") == "ABSTAIN", F.lit(False)).alias("abstained"),
        )
    )


def _retrieval_aggregates() -> dict[str, Column]:
    with_evidence = F.count_if("has_evidence")
    return {
        "case_count": F.count(F.lit(1)),
        "evidence_cases": with_evidence,
        **{
            f"{level}_recall_at{k}": _share(F.col(f"{level}_hit_at{k}"), with_evidence)
            for level in ("document", "chunk")
            for k in (1, 3, 8)
        },
        "mrr": _ratio(F.sum("reciprocal_rank"), with_evidence),
        "ndcg_at8": _ratio(F.sum("ndcg_at8"), with_evidence),
        "evidence_coverage_at8": _share(F.col("group_coverage_at8"), with_evidence),
        "primary_recall_at8": _share(F.col("primary_hit_at8"), with_evidence),
        "cross_dual_hit_at8": _ratio(
            F.count_if((F.col("question_type") == "CROSS_DOCUMENT") & F.col("dual_hit_at8")),
            F.count_if(F.col("question_type") == "CROSS_DOCUMENT"),
        ),
    }


def _answer_aggregates() -> dict[str, Column]:
    refusals = F.count_if("should_refuse")
    others = F.count_if(~F.col("should_refuse"))
    return {
        "fact_coverage": _ratio(F.sum("covered_facts"), F.sum("required_facts")),
        "forbidden_rate": _ratio(F.sum("hit_forbidden"), F.sum("forbidden_claims")),
        "citation_support": F.coalesce(F.avg("citation_support"), F.lit(0.0)),
        "refusal_compliance": _ratio_or_null(
            F.count_if(F.col("should_refuse") & F.col("refusal_compliant")), refusals
        ),
        "false_abstention": _ratio_or_null(
            F.count_if(~F.col("should_refuse") & F.col("abstained")), others
        ),
        "correct_abstention": _ratio_or_null(
            F.count_if(F.col("should_refuse") & F.col("abstained")), refusals
        ),
    }


def _columns(aggregates: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in aggregates.items()]


def case_scores(
    cases: DataFrame,
    evidence: DataFrame,
    ranked_list: DataFrame,
    assertions: DataFrame,
    answers: DataFrame,
) -> DataFrame:
    return retrieval_case_scores(cases, evidence, ranked_list).join(
        answer_case_scores(cases, assertions, answers), "case_key"
    )


def retrieval_metrics(scores: DataFrame) -> DataFrame:
    """One row over all cases; rates without an eligible case are 0, or null for refusals."""
    return scores.agg(*_columns({**_retrieval_aggregates(), **_answer_aggregates()}))


def metrics_by_type(scores: DataFrame) -> DataFrame:
    """The same per question type, plus the overall row (null type), in one pass."""
    wanted = {**_retrieval_aggregates(), **_answer_aggregates()}
    return scores.rollup("question_type").agg(*_columns(wanted))


def retrieval_funnel(
    cases: DataFrame, evidence: DataFrame, candidates: DataFrame, sources: DataFrame
) -> DataFrame:
    """Candidate hits at 10, 30 and 50, dual-document hits, and candidate source counts.

    `sources(case_key, source_kind)` has one row per candidate.
    """
    matched = evidence_match(evidence, candidates)
    fine = F.col("exact") & F.col("granularity").isin("CHUNK", "VERSION")
    per_case = matched.groupBy("case_key").agg(
        F.min("rank").alias("document_rank"),
        F.min(F.when(fine, F.col("rank"))).alias("chunk_rank"),
        F.count_distinct(F.when(F.col("rank") <= 50, F.col("document_id"))).alias("documents_hit"),
    )
    expected = evidence.select("case_key").distinct().withColumn("_has", F.lit(True))
    present = candidates.select("case_key").distinct()
    joined = (
        cases.join(present, "case_key", "left_semi")
        .join(expected, "case_key", "left")
        .join(per_case, "case_key", "left")
    )
    whole = F.count_if(F.coalesce("_has", F.lit(False)))
    cross = F.col("question_type") == "CROSS_DOCUMENT"
    aggregates = {
        f"candidate_{level}_recall_at{k}": _share(
            F.coalesce(F.col(f"{level}_rank") <= k, F.lit(False)), whole
        )
        for level in ("document", "chunk")
        for k in (10, 30, 50)
    }
    aggregates["cross_dual_hit_at50"] = _ratio(
        F.count_if(cross & F.coalesce(F.col("documents_hit") >= 2, F.lit(False))), F.count_if(cross)
    )
    totals = sources.agg(
        *[
            F.count_if(F.col("source_kind") == kind).alias(f"{kind}_candidates")
            for kind in ("lexical", "vector", "both")
        ]
    ).withColumn("_one", F.lit(1))
    hits = joined.agg(*_columns(aggregates)).withColumn("_one", F.lit(1))
    return hits.join(totals, "_one").drop("_one")


# --- answers -------------------------------------------------------------------------------


def answer_score(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """`cases(case_id, required_facts[], forbidden_claims[], refusal_expected)` against one answer."""
    said = answer_normalize(F.col("answer"), drop_joiners=False)
    found = lambda name: F.size(
        F.filter(name, lambda x: F.col("_answer").contains(answer_normalize(x, drop_joiners=False)))
    )
    joined = cases.join(answers.select("case_id", "answer"), "case_id", "left").withColumn("_answer", said)
    return joined.withColumns({"covered_facts": found("required_facts"), "hit_forbidden": found("forbidden_claims")}).select(
        "case_id",
        F.size("required_facts").alias("required_count"),
        "covered_facts",
        F.size("forbidden_claims").alias("forbidden_count"),
        "hit_forbidden",
        (
            ~F.col("refusal_expected") | ((F.col("covered_facts") > 0) & (F.col("hit_forbidden") == 0))
        ).alias("refusal_compliant"),
        (F.col("covered_facts") > 0).alias("specific"),
        F.coalesce(F.col("answer").contains(CITATION_MARK), F.lit(False)).alias("cited"),
    )


def _disc(column: str, p: float, guard: Column | None = None) -> Column:
    value = F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").cast("bigint")
    return value if guard is None else F.when(guard, value)


def gold_metrics(scores: DataFrame) -> DataFrame:
    """`scores` carries status, category, the answer score, latency_ms and token counts."""
    ok = F.col("status") == "succeeded"
    good = scores.filter(ok)
    refusal = F.col("category") == "refusal"
    done = good.agg(
        F.count(F.lit(1)).alias("succeeded"),
        _ratio(F.sum("covered_facts"), F.sum("required_count")).alias("fact_coverage_rate"),
        _ratio(F.sum("hit_forbidden"), F.sum("forbidden_count")).alias("forbidden_rate"),
        _ratio_or_null(
            F.count_if(refusal & F.col("refusal_compliant")), F.count_if(refusal)
        ).alias("refusal_rate"),
        F.sum("latency_ms").alias("latency_sum"),
        F.when(F.count("total_tokens") == F.count(F.lit(1)), F.sum("total_tokens")).alias("token_sum"),
        _disc("latency_ms", 0.5).alias("latency_p50"),
        _disc("latency_ms", 0.95).alias("latency_p95"),
        _disc("total_tokens", 0.5, F.count("total_tokens") == F.count(F.lit(1))).alias("token_p50"),
        _disc("total_tokens", 0.95, F.count("total_tokens") == F.count(F.lit(1))).alias("token_p95"),
        _share(F.col("specific"), F.count(F.lit(1))).alias("specific_rate"),
        _share(F.col("cited"), F.count(F.lit(1))).alias("citation_rate"),
    ).withColumn("_one", F.lit(1))
    totals = scores.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(~ok).alias("failed")
    ).withColumn("_one", F.lit(1))
    return totals.join(done, "_one").drop("_one")


def legacy_metrics(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """`cases(case_key, expected[])` as id prefixes against retrieved and cited ids."""
    joined = cases.join(observations, "case_key")
    met = F.size(
        F.filter("expected", lambda p: F.exists("retrieved", lambda r: r.startswith(p)))
    )
    right = F.size(F.array_intersect("cited", "retrieved"))
    cited = F.size("cited")
    ungrounded = F.col("claim") & ((cited == 0) | (right != cited))
    return joined.agg(
        _ratio(F.sum(met), F.sum(F.size("expected"))).alias("retrieval_recall"),
        _ratio(F.sum(right), F.sum(cited)).alias("citation_correctness"),
        _share(ungrounded, F.count(F.lit(1))).alias("ungrounded_rate"),
        F.count(F.lit(1)).alias("case_count"),
    )


# --- runs: retry, compare, gate ------------------------------------------------------------


def retry_merge(previous: DataFrame, rerun: DataFrame) -> DataFrame:
    """Passing cases of the previous run plus new results of the others; versions must agree."""
    renamed = rerun.select(
        "case_key",
        F.col("dataset_version").alias("_version"),
        F.col("status").alias("_status"),
        F.col("score").alias("_score"),
    )
    joined = previous.join(renamed, "case_key", "full_outer")
    foreign = F.col("dataset_version").isNull() | (
        F.col("_version").isNotNull() & (F.col("_version") != F.col("dataset_version"))
    )
    version = F.when(
        foreign, F.raise_error(F.concat(F.lit("runs do not belong together: "), F.col("case_key")))
    ).otherwise(F.col("dataset_version"))
    renewed = (F.col("status") != "succeeded") & F.col("_status").isNotNull()
    return joined.select(
        "case_key",
        version.alias("dataset_version"),
        F.when(renewed, F.col("_status")).otherwise(F.col("status")).alias("status"),
        F.when(renewed, F.col("_score")).otherwise(F.col("score")).alias("score"),
        (~renewed).alias("carried"),
    )


_RUN = ["category", "status", "covered_facts", "hit_forbidden", "refusal_compliant", "specific"]


def case_delta(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Change of every case between two runs; a case listed twice in a run stops the job."""

    def side(df: DataFrame, name: str) -> DataFrame:
        once = df.groupBy("case_id").agg(
            F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(f"{name}_{c}") for c in _RUN]
        )
        repeated = F.raise_error(
            F.concat(F.lit("case listed twice: "), F.col("case_id").cast("string"))
        ).cast(df.schema["case_id"].dataType)
        key = F.when(F.col("_n") > 1, repeated).otherwise(F.col("case_id"))
        return once.withColumn("case_id", key).drop("_n")

    j = side(baseline, "a").join(side(candidate, "b"), "case_id", "full_outer")
    facts = F.col("b_covered_facts") - F.col("a_covered_facts")
    forbidden = F.col("b_hit_forbidden") - F.col("a_hit_forbidden")

    def gained(name: str) -> Column:
        return ~F.col(f"a_{name}") & F.col(f"b_{name}")

    def lost(name: str) -> Column:
        return F.col(f"a_{name}") & ~F.col(f"b_{name}")

    failed_to_ok = (F.col("a_status") == "failed") & (F.col("b_status") == "succeeded")
    ok_to_failed = (F.col("a_status") == "succeeded") & (F.col("b_status") == "failed")
    better = (facts > 0) | (forbidden < 0) | gained("refusal_compliant") | gained("specific") | failed_to_ok
    worse = (facts < 0) | (forbidden > 0) | lost("refusal_compliant") | lost("specific") | ok_to_failed
    missing = F.col("a_covered_facts").isNull() | F.col("b_covered_facts").isNull()
    status = (
        F.when(missing, F.lit("missing"))
        .when(better & worse, F.lit("mixed"))
        .when(better, F.lit("improved"))
        .when(worse, F.lit("regressed"))
        .otherwise(F.lit("unchanged"))
    )
    changed = lambda n: F.when(
        ~missing & (F.col(f"a_{n}") != F.col(f"b_{n}")), F.col(f"b_{n}")
    )
    return j.select(
        "case_id",
        F.coalesce("b_category", "a_category").alias("category"),
        status.alias("change"),
        F.when(~missing, facts).alias("fact_delta"),
        F.when(~missing, forbidden).alias("forbidden_delta"),
        changed("refusal_compliant").alias("refusal_now"),
        changed("specific").alias("specific_now"),
    )


def _dropped(name: str, by: float = MAX_DROP) -> Column:
    return F.col(f"c.{name}") < F.col(f"b.{name}") - F.lit(by)


def _rose(name: str, by: float) -> Column:
    return F.col(f"c.{name}") > F.col(f"b.{name}") + F.lit(by)


def regression_gate(baseline: DataFrame, candidate: DataFrame, key: str = "dataset_key") -> DataFrame:
    """Violations of a candidate's metric row against its baseline row; none means passed."""
    rules = {
        "document_recall_at8_regressed": _dropped("document_recall_at8"),
        "chunk_recall_at8_regressed": _dropped("chunk_recall_at8"),
        "final_evidence_coverage_at8_regressed": _dropped("evidence_coverage_at8"),
        "required_fact_coverage_regressed": _dropped("fact_coverage"),
        "forbidden_claim_rate_regressed": _rose("forbidden_rate", MAX_FORBIDDEN_RISE),
        "should_refuse_compliance_regressed": _dropped("refusal_compliance"),
        "false_abstention_rate_regressed": _rose("false_abstention", MAX_ABSTENTION_RISE),
        "citation_support_rate_regressed": _dropped("citation_support"),
        "failed_case_count_increased": F.col("c.failed_cases") > F.col("b.failed_cases"),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(n)) for n, rule in rules.items()]))
    mismatch = F.coalesce(F.col("b.checksum") != F.col("c.checksum"), F.lit(False))
    joined = baseline.alias("b").join(candidate.alias("c"), key)
    violations = F.when(mismatch, F.array(F.lit("dataset_checksum_mismatch"))).otherwise(found)
    return joined.select(key, violations.alias("violations")).withColumn(
        "passed", F.size("violations") == 0
    )


def answer_gate(baseline: DataFrame, candidate: DataFrame, key: str = "dataset_key") -> DataFrame:
    """The gate of answer-only runs."""
    rules = {
        "fact_coverage_regressed": _dropped("fact_coverage_rate"),
        "forbidden_claim_rate_regressed": _rose("forbidden_rate", MAX_FORBIDDEN_RISE),
        "refusal_compliance_regressed": _dropped("refusal_rate"),
        "answer_specificity_regressed": _dropped("specific_rate"),
        "failed_case_count_increased": F.col("c.failed") > F.col("b.failed"),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(n)) for n, rule in rules.items()]))
    return (
        baseline.alias("b")
        .join(candidate.alias("c"), key)
        .select(key, found.alias("violations"))
        .withColumn("passed", F.size("violations") == 0)
    )


def rerank_movement(scores: DataFrame) -> DataFrame:
    """`scores(before_rank, after_rank, fallback, latency_ms, reranker)`; rank 0 means absent."""
    real = ~F.col("fallback") & (F.col("reranker") == "cross-encoder")
    before, after = F.col("before_rank"), F.col("after_rank")
    timed = F.col("latency_ms").isNotNull()
    return scores.agg(
        F.count_if(real & (before > TOP) & after.between(1, TOP)).alias("gained"),
        F.count_if(real & before.between(1, TOP) & (after == 0)).alias("lost"),
        F.count_if(real & (before > 0) & ((after == 0) | (after > before))).alias("demoted"),
        _ratio(F.count_if(timed & F.col("fallback")), F.count_if(timed)).alias("fallback_rate"),
        _disc("latency_ms", 0.5).alias("latency_p50"),
        _disc("latency_ms", 0.95).alias("latency_p95"),
    )


def variant_compare(baseline: DataFrame, variants: DataFrame) -> DataFrame:
    """Per variant: totals, cases gained, lost, kept, missed, and dual hits of composite cases."""
    base = baseline.select(
        "case_key", F.col("hit").alias("_hit"), F.col("dual_hit").alias("_dual"), "question_type"
    )
    joined = variants.select("variant", "case_key", "hit", "dual_hit").join(base, "case_key")
    cross = F.col("question_type") == "CROSS_DOCUMENT"
    return joined.groupBy("variant").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("_hit").alias("baseline_hits"),
        F.count_if("hit").alias("variant_hits"),
        F.count_if(~F.col("_hit") & F.col("hit")).alias("gained"),
        F.count_if(F.col("_hit") & ~F.col("hit")).alias("lost"),
        F.count_if(F.col("_hit") & F.col("hit")).alias("stay_hit"),
        F.count_if(~F.col("_hit") & ~F.col("hit")).alias("stay_miss"),
        F.count_if(cross & F.col("_dual")).alias("baseline_dual"),
        F.count_if(cross & F.col("dual_hit")).alias("variant_dual"),
        F.count_if(cross).alias("cross_cases"),
    )


# Fixed value: cases taken per question type.
PROBE_QUOTA = [
    ("SINGLE_DOCUMENT_FACT", 8),
    ("CROSS_DOCUMENT", 4),
    ("VERSION_CONFLICT", 2),
    ("OPERATION_PROCESS", 1),
]
PROBE_FILL_TYPE = "SINGLE_DOCUMENT_FACT"


def hard_case_mining(
    scores: DataFrame, quota: list[tuple[str, int]] = PROBE_QUOTA, n: int = 15
) -> DataFrame:
    """Cases found among the candidates but ranked just below the cut, by quota, then filled up.

    `scores(case_key, question_type, candidate_hit_at50, chunk_hit_at8, gold_rank)`.
    """
    near = scores.filter(
        F.col("candidate_hit_at50") & ~F.col("chunk_hit_at8") & F.col("gold_rank").between(9, 20)
    )
    allowed, place = F.lit(0), F.lit(None).cast("int")
    for position, (name, size) in enumerate(quota):
        allowed = F.when(F.col("question_type") == name, F.lit(size)).otherwise(allowed)
        place = F.when(F.col("question_type") == name, F.lit(position)).otherwise(place)
    most = max(size for _, size in quota) + n
    listed = ranked(near, most, ["gold_rank", "case_key"], "question_type").withColumns(
        {"_allowed": allowed, "_place": place}
    )
    by_quota = F.col("rank") <= F.col("_allowed")
    fill = ~by_quota & (F.col("question_type") == PROBE_FILL_TYPE)
    chosen = listed.filter(by_quota | fill).withColumn("filled", fill)
    return (
        chosen.orderBy("filled", "_place", "gold_rank", "case_key")
        .limit(n)
        .select("case_key", "question_type", "gold_rank", "filled")
    )


# --- datasets ------------------------------------------------------------------------------


def case_slice(cases: DataFrame, keys: DataFrame) -> DataFrame:
    """Cases named in a key list with `#` comments; selecting nothing is an error."""
    wanted = (
        keys.select(F.trim("value").alias("case_key"))
        .filter((F.col("case_key") != "") & ~F.col("case_key").startswith("#"))
        .distinct()
    )
    chosen = cases.join(wanted, "case_key", "left_semi")
    if chosen.isEmpty():
        raise ValueError("the case list selects no case")
    return chosen


def case_histogram(cases: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Cases per value in list order, zero where there is none."""
    counters = [F.count_if(F.col(column) == v).alias(f"c{i}") for i, v in enumerate(values)]
    rows = F.array(
        *[
            F.struct(F.lit(v).alias(column), F.col(f"c{i}").alias("cases"))
            for i, v in enumerate(values)
        ]
    )
    return cases.agg(*counters).select(F.inline(rows))


def dataset_snapshot(
    dataset: DataFrame, cases: DataFrame, evidence: DataFrame, assertions: DataFrame
) -> DataFrame:
    """One nested row per case. What is collected is one case's own evidence and assertions."""
    evidences = evidence.groupBy("case_key").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "sort_order", "granularity", "document_id", "version_no", "chunk_id", "requirement_key"
                )
            )
        ).alias("evidences")
    )
    claims = assertions.groupBy("case_key").agg(
        F.array_sort(
            F.collect_list(F.struct("sort_order", "assertion_type", "assertion_text", "weight"))
        ).alias("assertions")
    )
    return (
        cases.join(dataset, "dataset_key")
        .join(evidences, "case_key", "left")
        .join(claims, "case_key", "left")
    )


def dataset_checksum(
    dataset: DataFrame, cases: DataFrame, evidence: DataFrame, assertions: DataFrame
) -> DataFrame:
    """SHA-256 of each dataset's canonical text: its head, then case, evidence and assertion lines.

    Lines are rows. Spark sorts those of a dataset, on disk where they do not fit, and they stream
    through the digest a batch at a time; a dataset's text is never put together. The digest of one
    text is sequential, so this stream is one task per dataset. Keys of datasets and cases are
    unique; evidence and assertions of unknown cases count for nothing.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))

    def lines(rows: DataFrame, part: int, kind: str, order: Column, columns: list[Column]) -> DataFrame:
        line = F.concat(F.lit(kind), F.concat_ws("|", *columns), F.lit("\n"))
        key = F.col("case_key") if part else F.lit(None).cast("string")
        return rows.select("dataset_key", F.lit(part).alias("part"), key.alias("case_key"), order.alias("at"), line.alias("line"))

    keys = cases.select("dataset_key", "case_key")
    none = F.lit(None).cast("long")
    at = F.col("sort_order").cast("long")
    head = [text(c) for c in ("dataset_key", "dataset_version", "split", "corpus_version")]
    case = [text(c) for c in ("case_key", "question_text", "question_type", "difficulty", "should_refuse")]
    proof = [text(c) for c in ("case_key", "granularity", "document_id", "version_no", "chunk_id")]
    claim = [text(c) for c in ("case_key", "assertion_type", "assertion_text", "weight")]
    every = (
        lines(dataset, 0, "", none, head)
        .unionByName(lines(cases, 1, "case:", none, case))
        .unionByName(lines(evidence.join(keys, "case_key"), 2, "evidence:", at, [*proof, F.coalesce("requirement_key", F.lit(""))]))
        .unionByName(lines(assertions.join(keys, "case_key"), 3, "assertion:", at, claim))
    )
    kind = dataset.schema["dataset_key"].dataType.simpleString()
    ordered = every.repartition("dataset_key").sortWithinPartitions("dataset_key", "part", "case_key", "at", "line")
    return ordered.select("dataset_key", "part", "line").mapInArrow(_checksums, f"dataset_key {kind}, checksum string")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the lines of each key, which follow each other; a key without a head (part 0) has none."""
    key, sha = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), pa.array([sha.hexdigest()])], names=["dataset_key", "checksum"])

    for batch in batches:
        keys, n = batch.column(0), batch.num_rows
        if not n:
            continue
        cuts = [0, *(np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).fill_null(True).to_numpy(zero_copy_only=False)) + 1), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if key is None or keys[int(a)] != key:
                if sha is not None:
                    yield row()
                key, sha = keys[int(a)], hashlib.sha256() if batch.column(1)[int(a)].as_py() == 0 else None
            if sha is not None:
                part = batch.column(2).slice(int(a), int(b - a)).cast(pa.large_string())
                _, offsets, data = part.buffers()
                at = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
                sha.update(memoryview(data)[int(at[0]) : int(at[-1])])
    if sha is not None:
        yield row()


def gold_data_quality(
    dataset: DataFrame,
    cases: DataFrame,
    evidence: DataFrame,
    assertions: DataFrame,
    turns: DataFrame,
    reviewer: str,
) -> DataFrame:
    """Every violated rule as a row (case_key, rule); dataset rules carry the dataset key."""
    split_prefix = F.lit(None).cast("string")
    for name, prefix in SPLITS.items():
        split_prefix = F.when(F.col("split") == name, F.lit(prefix)).otherwise(split_prefix)
    sizes = cases.groupBy("dataset_key").agg(F.count(F.lit(1)).alias("_cases"))
    heads = dataset.join(sizes, "dataset_key", "left")
    text_fields = ["dataset_key", "dataset_version", "split", "corpus_version", "ws"]
    head_rules = {
        **{f"missing_{c}": is_blank(F.col(c).cast("string")) for c in text_fields},
        "no_cases": F.coalesce("_cases", F.lit(0)) == 0,
        "bad_split": ~F.col("split").isin(list(SPLITS)),
    }
    ev = evidence.groupBy("case_key").agg(
        F.count(F.lit(1)).alias("_evidence"),
        F.count_if(~F.col("granularity").isin(GRANULARITIES)).alias("_bad_evidence"),
    )
    as_ = assertions.groupBy("case_key").agg(
        F.count(F.lit(1)).alias("_assertions"),
        F.count_if(~F.col("assertion_type").isin(ASSERTION_TYPES)).alias("_bad_type"),
        F.count_if(F.col("weight") <= 0).alias("_bad_weight"),
        F.count_if(F.col("assertion_type") == "REQUIRED_FACT").alias("_required"),
        F.count_if(F.col("assertion_type") == "FORBIDDEN_CLAIM").alias("_forbidden"),
    )
    tu = turns.groupBy("case_key").agg(
        F.count(F.lit(1)).alias("_turns"),
        F.count_if(F.col("role").isNull() | ~F.col("role").isin(TURN_ROLES)).alias("_bad_role"),
        F.count_if(is_blank(F.col("content"))).alias("_blank_turn"),
    )
    copies = cases.groupBy("dataset_key", "case_key").agg(F.count(F.lit(1)).alias("_copies"))
    counted = (
        cases.join(copies, ["dataset_key", "case_key"])
        .join(dataset.select("dataset_key", "split"), "dataset_key")
        .join(ev, "case_key", "left")
        .join(as_, "case_key", "left")
        .join(tu, "case_key", "left")
        .fillna(0)
    )
    empty_type = F.col("question_type").isin(EMPTY_EVIDENCE_TYPES)
    case_rules = {
        "bad_case_key_prefix": ~F.col("case_key").startswith(split_prefix),
        "duplicate_case_key": F.col("_copies") > 1,
        "bad_question_type": ~F.col("question_type").isin(QUESTION_TYPES),
        "bad_difficulty": ~F.col("difficulty").isin(DIFFICULTIES),
        "bad_reviewer": ~F.col("reviewer").eqNullSafe(F.lit(reviewer)),
        "refuse_mismatch": F.col("question_type").isin(ABSTAIN_TYPES) != F.col("should_refuse"),
        "unexpected_evidence": empty_type & (F.col("_evidence") > 0),
        "missing_evidence": ~empty_type & (F.col("_evidence") == 0),
        "too_many_turns": F.col("_turns") > MAX_CONTEXT_TURNS,
        "bad_turn_role": F.col("_bad_role") > 0,
        "blank_turn": F.col("_blank_turn") > 0,
        "bad_granularity": F.col("_bad_evidence") > 0,
        "too_few_assertions": F.col("_assertions") < 2,
        "bad_assertion_type": F.col("_bad_type") > 0,
        "bad_weight": F.col("_bad_weight") > 0,
        "missing_required_fact": F.col("_required") == 0,
        "missing_forbidden_claim": F.col("_forbidden") == 0,
    }

    def broken(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(rule, F.lit(n)) for n, rule in rules.items()]))
        return df.select(F.col(key).alias("case_key"), F.explode(found).alias("rule")).distinct()

    return broken(heads, "dataset_key", head_rules).unionByName(broken(counted, "case_key", case_rules))


def evidence_resolution(evidence: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence references turned into corpus ids, and those the manifest does not hold.

    `manifest(document_ref, version_no, chunk_no, document_id, chunk_id)`, one row per chunk. Every
    granularity names a chunk, so one equi-join resolves all of them.
    """
    key = ["document_ref", "version_no", "chunk_no"]
    resolved = evidence.join(manifest.select(*key, "document_id", "chunk_id"), key, "left")
    found = F.col("document_id").isNotNull()
    return resolved.filter(found), resolved.filter(~found).drop("document_id", "chunk_id")


def ablation_summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Latest run per (variant, slice) as percent texts, `-` where a metric is missing."""
    newest = runs.groupBy("variant", "slice").agg(
        F.max_by(F.struct(*metrics, "checksum"), F.struct("created_at", "run_id")).alias("r")
    )
    shown = [
        F.when(F.col(f"r.{m}").isNull(), F.lit("-"))
        .otherwise(F.format_string("%.1f%%", F.round(F.col(f"r.{m}") * 100, 1)))
        .alias(m)
        for m in metrics
    ]
    return newest.select("variant", "slice", *shown, F.coalesce("r.checksum", F.lit("-")).alias("checksum"))
