"""Batch retrieval: a question table in, ranked evidence and gate decisions out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.questions import force_abstain, query_expand
from tallyvox.operators import retrieval as rt
from tallyvox.operators import search
from tallyvox.operators import selection as sl
from tallyvox.session import materialize, small_side, stored


def retrieve(questions: DataFrame, chunks: DataFrame, vector_k: int = 40, lexical_k: int = 40) -> dict[str, DataFrame]:
    """`questions(query_id, text, question_type, embedding)` over visible `chunks`.

    Both arms run per sub-query; sub-query lists are fused, boosted, selected and gated. Chunks are
    written once, because both arms, the identifiers and the described candidates read them.
    """
    chunks = stored(chunks)
    parts = rt.split_subqueries(questions).join(questions.select("query_id", "embedding"), "query_id")
    keyed = materialize(
        parts.select(
            F.struct("query_id", "sub_no").alias("_key"),
            F.concat_ws("#", F.col("query_id").cast("string"), F.col("sub_no").cast("string")).alias("query_id"),
            "text",
            query_expand(F.col("text")).alias("expanded"),
            "embedding",
        )
    )
    lexical = search.lexical_arm(keyed, chunks, lexical_k)
    vector = search.vector_arm(keyed, chunks, vector_k)
    fused = rt.rrf_fuse(lexical, vector).join(keyed.select("query_id", "_key"), "query_id")
    lists = fused.select("_key.query_id", "_key.sub_no", "chunk_id", "rank", "score", "source_kind")
    lists = materialize(lists)
    merged = rt.subquery_rrf(lists)
    extra = rt.identifier_supplement(questions, chunks).select(
        "query_id", "chunk_id", "score", F.lit("lexical").alias("source_kind")
    )
    candidates = materialize(rt.round_merge(merged, extra))
    described = small_side(candidates).join(
        chunks.select("chunk_id", "document_id", "title", "section_heading", "content", "document_type"),
        "chunk_id",
    )
    signals = sl.entity_signals(questions)
    boosted = materialize(sl.entity_boost(described, signals))
    pool = boosted.join(described.drop("score", "rank", "source_kind", "document_id"), ["query_id", "chunk_id"])
    chosen = sl.subquery_quota(pool, lists, signals)
    gate = rt.evidence_gate(
        chosen, questions, force_abstain(F.col("text"), F.col("question_type"))
    )
    return {
        "candidates": boosted,
        "evidence": rt.gated_evidence(chosen, gate),
        "gate": gate,
    }
