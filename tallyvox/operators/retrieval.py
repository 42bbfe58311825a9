"""Retrieval stages over whole question tables: visibility, fusion, merging, identifiers, gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.questions import (
    CONNECTORS,
    body_of,
    identifiers,
    parts_of,
    scene_of,
    shared_aspect,
    split_body,
    subqueries,
)
from tallyvox.functions.text import is_blank, java_trim
from tallyvox.operators.dashboard import ranked
from tallyvox.operators.ordering import running_before

# Fusion constant, list sizes, identifier score, gate thresholds.
RRF_K = 60
CANDIDATES = 50
FINAL = 8
SUPPLEMENT_SCORE = 0.12
NEIGHBOUR_FACTOR = 0.85
SUPPLEMENT_LIMIT = 5
GATE = {False: (0.02, 0.0164), True: (0.35, 0.25)}
CONTEXT_CHARS = 1000
LEGACY_K = 32
COVER_WEIGHT = 0.1  # of a word without a label


def split_subqueries(queries: DataFrame) -> DataFrame:
    parts = subqueries(F.col("text"), F.col("question_type"))
    return queries.select("query_id", F.posexplode_outer(parts).alias("sub_no", "text")).withColumn(
        "sub_no", F.col("sub_no") + 1
    )


def visible_chunks(
    chunks: DataFrame,
    versions: DataFrame,
    docs: DataFrame,
    org: int,
    ws: int,
    as_of: Column,
    types: list[str] | None = None,
) -> DataFrame:
    """Chunks of published versions in effect, in documents the workspace may see."""
    shown = docs.filter(
        (F.col("org_id") == org) & (F.col("target_ws").isNull() | (F.col("target_ws") == ws))
    )
    if types:
        shown = shown.filter(F.col("document_type").isin(types))
    live = versions.filter(
        (F.col("status") == "PUBLISHED")
        & (F.col("effective_from").isNull() | (F.col("effective_from") <= as_of))
        & (F.col("effective_to").isNull() | (F.col("effective_to") >= as_of))
    )
    return chunks.join(live, ["document_id", "version_no"]).join(shown, "document_id")


def rrf_fuse(lexical: DataFrame, vector: DataFrame, k: int = RRF_K, top: int = CANDIDATES) -> DataFrame:
    """Two ranked arms (query_id, chunk_id, rank) into one list with its source."""
    a = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"))
    b = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    kind = (
        F.when(F.col("vector_rank").isNull(), F.lit("lexical"))
        .when(F.col("lexical_rank").isNull(), F.lit("vector"))
        .otherwise(F.lit("both"))
    )
    fused = a.join(b, ["query_id", "chunk_id"], "full_outer").withColumns(
        {"score": part("lexical_rank") + part("vector_rank"), "source_kind": kind}
    )
    return ranked(fused, top, [F.desc("score"), "chunk_id"], "query_id")


def provenance_sets(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """Lexical-only, vector-only and shared candidates, as one labelled set."""
    a = lexical.select("query_id", "chunk_id").distinct().withColumn("in_lexical", F.lit(True))
    b = vector.select("query_id", "chunk_id").distinct().withColumn("in_vector", F.lit(True))
    joined = a.join(b, ["query_id", "chunk_id"], "full_outer").fillna(False)
    return joined.withColumn("source_kind", _kind(F.col("in_lexical"), F.col("in_vector")))


def _kind(lexical: Column, vector: Column) -> Column:
    return (
        F.when(lexical & vector, F.lit("both"))
        .when(lexical, F.lit("lexical"))
        .when(vector, F.lit("vector"))
    )


def _merged(lists: DataFrame, score: Column, top: int) -> DataFrame:
    from_lexical = F.col("source_kind").isin("lexical", "both")
    from_vector = F.col("source_kind").isin("vector", "both")
    merged = lists.groupBy("query_id", "chunk_id").agg(
        score.alias("score"),
        _kind(F.bool_or(from_lexical), F.bool_or(from_vector)).alias("source_kind"),
    )
    return ranked(merged, top, [F.desc("score"), "chunk_id"], "query_id")


def subquery_rrf(lists: DataFrame, k: int = RRF_K, top: int = CANDIDATES) -> DataFrame:
    """`lists(query_id, sub_no, chunk_id, rank, score, source_kind)`; one list passes unchanged.

    Summed in sub-query order, so equal inputs give equal scores.
    """
    parts = F.array_sort(F.collect_list(F.struct("sub_no", "rank")))
    summed = F.aggregate(
        parts, F.lit(0.0), lambda acc, p: acc + F.lit(1.0) / (F.lit(k) + p["rank"])
    )
    several = lists.groupBy("query_id").agg(F.max("sub_no").alias("_subs"))
    known = lists.join(several, "query_id")
    score = F.when(F.max("_subs") > 1, summed).otherwise(F.max("score"))
    return _merged(known, score, top)


def round_merge(narrow: DataFrame, broad: DataFrame, top: int = CANDIDATES) -> DataFrame:
    columns = ["query_id", "chunk_id", "score", "source_kind"]
    both = narrow.select(*columns).unionByName(broad.select(*columns))
    return _merged(both, F.max("score"), top)


# --- identifiers ---------------------------------------------------------------------------

# Every place a text can contain an identifier lies in one of these runs.
IDENTIFIER_RUN = r"[A-Z]{2,}-\d{3,}"
LETTERS, DIGITS = (2, 6), (3, 6)  # lengths of an identifier's two parts


def _inside(run: Column) -> Column:
    """All identifiers a run contains: its last letters and its first digits; at most 20."""
    letters, digits = F.substring_index(run, "-", 1), F.substring_index(run, "-", -1)

    def lengths(part: Column, bounds: tuple[int, int]) -> Column:
        return F.sequence(F.lit(bounds[0]), F.least(F.length(part), F.lit(bounds[1])))

    return F.flatten(
        F.transform(
            lengths(letters, LETTERS),
            lambda n: F.transform(
                lengths(digits, DIGITS),
                lambda m: F.concat(F.right(letters, n), F.lit("-"), F.left(digits, m)),
            ),
        )
    )


def identifier_hits(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose title, content or index text contains an identifier.

    `wanted(identifier)`. The identifiers inside each text are made in the scan and meet the wanted
    ones by an equi-join; no text is shuffled.
    """
    haystack = F.upper(
        F.concat_ws("\n", "title", "content", F.coalesce("lexical_text", F.lit("")))
    )
    runs = F.regexp_extract_all(haystack, F.lit(IDENTIFIER_RUN), F.lit(0))
    held = F.array_distinct(F.flatten(F.transform(runs, _inside)))
    located = chunks.select("version_id", "chunk_no", "chunk_id", F.explode_outer(held).alias("identifier"))
    return located.join(wanted.select("identifier").distinct(), "identifier").select(
        "identifier", "version_id", "chunk_no", "chunk_id"
    )


def identifier_union(hits: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Best score per (identifier, chunk)."""
    columns = ["identifier", "chunk_id", "score"]
    return (
        hits.select(*columns)
        .unionByName(neighbours.select(*columns))
        .groupBy("identifier", "chunk_id")
        .agg(F.max("score").alias("score"))
    )


def identifier_neighbours(hits: DataFrame, chunks: DataFrame, score: float) -> DataFrame:
    """Chunks just before and after a hit in the same version."""
    beside = hits.select(
        "identifier",
        "version_id",
        F.explode(F.array(F.col("chunk_no") - 1, F.col("chunk_no") + 1)).alias("chunk_no"),
    ).distinct()
    return beside.join(
        chunks.select("version_id", "chunk_no", "chunk_id"), ["version_id", "chunk_no"]
    ).withColumn("score", F.lit(score))


def identifier_supplement(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = SUPPLEMENT_LIMIT,
    score: float = SUPPLEMENT_SCORE,
    flat_scores: bool = True,
) -> DataFrame:
    """Extra candidates for identifiers named in a question, at most `k` per identifier.

    The first `k` by chunk id are taken. With `flat_scores` neighbours carry the full score too,
    as results are compared with; otherwise they carry their reduced score.
    """
    named = queries.select("query_id", F.explode_outer(identifiers(F.col("text"))).alias("identifier")).filter(
        F.col("identifier").isNotNull()
    )
    hits = identifier_hits(named, chunks)
    neighbours = identifier_neighbours(hits, chunks, score * NEIGHBOUR_FACTOR)
    united = identifier_union(hits.withColumn("score", F.lit(score)), neighbours)
    if flat_scores:
        united = united.withColumn("score", F.lit(score))
    first = ranked(united, k, ["chunk_id"], "identifier").drop("rank")
    return named.join(first, "identifier").select("query_id", "identifier", "chunk_id", "score")


# --- legacy lexical arm --------------------------------------------------------------------


def _words(c: Column) -> Column:
    return F.filter(
        F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""
    )


def cover_density(entries: Column, words: Column) -> Column:
    """Rank of a text for a question from `entries`, an array of (pos, word) by position, word from 0 to `words` - 1.

    A cover is a span that holds every word of the question and no shorter such span. Each adds
    COVER_WEIGHT over one plus the number of other words inside it, so close words count more than
    frequent ones. One sweep: the last place of each word is kept, the earliest of them begins the
    cover that ends here, and it is a new one if it begins behind the one before.
    """
    nowhere = F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("at"))
    state = F.struct(
        F.lit(0).alias("at"),
        F.array_repeat(nowhere, words).alias("last"),
        F.lit(-1).alias("start"),
        F.lit(0.0).alias("score"),
    )

    def step(seen: Column, entry: Column) -> Column:
        here = F.struct(entry["pos"].alias("pos"), seen["at"].alias("at"))
        last = F.transform(seen["last"], lambda x, k: F.when(k == entry["word"], here).otherwise(x))
        low = F.array_min(last)
        others = (entry["pos"] - low["pos"]) - (seen["at"] - low["at"])
        new = low["pos"] > seen["start"]
        return F.struct(
            (seen["at"] + 1).alias("at"),
            last.alias("last"),
            F.greatest(seen["start"], low["pos"]).alias("start"),
            F.when(new, seen["score"] + COVER_WEIGHT / (1 + others)).otherwise(seen["score"]).alias("score"),
        )

    return F.aggregate(entries, state, step, lambda seen: F.round(seen["score"], 12))


def legacy_lexical(queries: DataFrame, chunks: DataFrame, k: int = LEGACY_K) -> DataFrame:
    """Chunks that hold every word of a question, by cover density.

    A question meets chunks only on its rarest word, so common words form no pairs. Rows hold one
    word with its positions in one chunk; no list of words is shuffled. Scores are rounded to twelve
    digits, ties go by chunk id. Questions without words find nothing.
    """
    asked = queries.select("query_id", F.array_distinct(_words(F.col("text"))).alias("_wanted"))
    wanted = asked.select(
        "query_id", F.size("_wanted").alias("_size"), F.posexplode("_wanted").alias("_no", "_word")
    )
    held = (
        chunks.select("chunk_id", F.posexplode_outer(_words(F.col("content"))).alias("_pos", "_word"))
        .join(wanted.select("_word").distinct(), "_word", "left_semi")
        .groupBy("chunk_id", "_word")
        .agg(F.collect_list("_pos").alias("_places"))
    )
    frequency = held.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    rarest = wanted.join(frequency, "_word", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    anchor = ranked(rarest, 1, ["_n", "_word"], "query_id").filter(F.col("_n") > 0)
    pairs = held.select("chunk_id", "_word").join(anchor.select("query_id", "_word"), "_word").drop("_word")
    found = (
        pairs.join(wanted, "query_id")
        .join(held, ["chunk_id", "_word"])
        .select(
            "query_id",
            "chunk_id",
            "_size",
            F.transform(
                "_places", lambda p: F.struct(p.alias("pos"), F.col("_no").alias("word"))
            ).alias("_entries"),
        )
        .groupBy("query_id", "chunk_id")
        .agg(
            F.count(F.lit(1)).alias("_met"),
            F.first("_size").alias("_size"),
            F.sort_array(F.flatten(F.collect_list("_entries"))).alias("_entries"),
        )
        .filter(F.col("_met") == F.col("_size"))
        .select("query_id", "chunk_id", cover_density(F.col("_entries"), F.col("_size")).alias("score"))
    )
    return ranked(found, k, [F.desc("score"), "chunk_id"], "query_id")


# --- gate and context ----------------------------------------------------------------------


def evidence_gate(
    candidates: DataFrame, queries: DataFrame, force: Column, reranked: bool = False
) -> DataFrame:
    """Per question: abstain or inject, how many candidates came in and passed, the top score.

    The top score is that of rank 1. `force` is evaluated on `queries`.
    """
    bound, minimum = GATE[reranked]
    per_query = candidates.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_in"),
        F.min_by("score", "rank").alias("_top"),
        F.count_if(F.col("score") >= minimum).alias("_ok"),
    )
    joined = queries.select("query_id", force.alias("_force")).join(per_query, "query_id", "left")
    top = F.coalesce("_top", F.lit(0.0))
    passed = F.coalesce("_ok", F.lit(0))
    inject = ~F.col("_force") & (top >= bound) & (passed > 0)
    return joined.select(
        "query_id",
        F.when(inject, F.lit("INJECT")).otherwise(F.lit("ABSTAIN")).alias("outcome"),
        F.coalesce("_in", F.lit(0)).alias("input_count"),
        F.when(inject, passed).otherwise(F.lit(0)).alias("injected_count"),
        top.alias("top_score"),
    )


def gated_evidence(candidates: DataFrame, decisions: DataFrame, reranked: bool = False) -> DataFrame:
    passed = candidates.filter(F.col("score") >= GATE[reranked][1])
    return passed.join(decisions.filter("outcome = 'INJECT'"), "query_id", "left_semi")


def _grow(limit: int):
    """Widens the hit to both sides in turn while the joined text fits."""

    def snippet(contents: list[str], anchor: int) -> str:
        low, high, size = anchor, anchor, len(contents[anchor])
        grew = True
        while grew:
            grew = False
            if low > 0 and size + 1 + len(contents[low - 1]) <= limit:
                low, size, grew = low - 1, size + 1 + len(contents[low - 1]), True
            if high + 1 < len(contents) and size + 1 + len(contents[high + 1]) <= limit:
                high, size, grew = high + 1, size + 1 + len(contents[high + 1]), True
        return "\n".join(contents[low : high + 1])[:limit]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for slices, start in zip(batch["slices"], batch["anchor_no"]):
                contents = [s["content"] for s in slices]
                anchor = [s["chunk_no"] for s in slices].index(start)
                texts.append(snippet(contents, anchor))
            yield pd.DataFrame(
                {"query_id": batch["query_id"], "chunk_id": batch["chunk_id"], "snippet": texts}
            )

    return run


def section_expand(hits: DataFrame, chunks: DataFrame, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """A hit becomes its whole section when that fits, else the hit and what fits around it.

    Chunks of a section are placed on a character axis. Only chunks within `max_chars` of the hit
    can take part, so a hit meets three buckets of that axis instead of the whole section. Sections
    without a hit are left out first, and contents are fetched for the chunks that take part.
    """
    key = ["version_id", "section"]
    lean = chunks.select(
        "version_id",
        F.coalesce(java_trim(F.col("section_heading")), F.lit("")).alias("section"),
        "chunk_no",
        "chunk_id",
        F.length("content").cast("long").alias("chars"),
        F.sha2("content", 256).alias("digest"),
    )
    hit_sections = lean.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").select(*key).distinct()
    placed = running_before(
        lean.join(hit_sections, key, "left_semi"), key, ["chunk_no"], F.col("chars") + 1, "offset"
    )
    totals = placed.groupBy(*key).agg((F.sum(F.col("chars") + 1) - 1).alias("section_chars"))
    first_same = placed.groupBy(*key, "digest").agg(
        F.min_by(F.struct("chunk_no", "offset"), "chunk_no").alias("anchor")
    )
    asked = (
        hits.select("query_id", "chunk_id")
        .join(placed.select(*key, "chunk_id", "digest"), "chunk_id")
        .join(first_same, [*key, "digest"])
        .join(totals, key)
        .select("query_id", "chunk_id", *key, "section_chars", "anchor.chunk_no", "anchor.offset")
        .withColumnsRenamed({"chunk_no": "anchor_no", "offset": "anchor_at"})
    )
    bucket = lambda c: F.floor(c / F.lit(max_chars))
    reach = asked.withColumn(
        "bucket",
        F.explode(
            F.sequence(
                F.when(F.col("section_chars") <= max_chars, F.lit(0).cast("long")).otherwise(
                    bucket(F.col("anchor_at")) - 1
                ),
                F.when(F.col("section_chars") <= max_chars, F.lit(1).cast("long")).otherwise(
                    bucket(F.col("anchor_at")) + 1
                ),
            )
        ),
    )
    near = reach.join(
        placed.select(*key, "chunk_no", F.col("chunk_id").alias("piece"), bucket(F.col("offset")).alias("bucket")),
        [*key, "bucket"],
    ).join(chunks.select(F.col("chunk_id").alias("piece"), "content"), "piece")
    gathered = near.groupBy("query_id", "chunk_id", "section_chars", "anchor_no").agg(
        F.array_sort(F.collect_list(F.struct("chunk_no", "content"))).alias("slices")
    )
    whole = gathered.filter(F.col("section_chars") <= max_chars).select(
        "query_id",
        "chunk_id",
        F.array_join(F.transform("slices", lambda s: s["content"]), "\n").alias("snippet"),
    )
    q_type = hits.schema["query_id"].dataType.simpleString()
    c_type = hits.schema["chunk_id"].dataType.simpleString()
    grown = (
        gathered.filter(F.col("section_chars") > max_chars)
        .select("query_id", "chunk_id", "anchor_no", "slices")
        .mapInPandas(_grow(max_chars), f"query_id {q_type}, chunk_id {c_type}, snippet string")
    )
    return whole.unionByName(grown)


# --- embedding text ------------------------------------------------------------------------


def embed_text(chunks: DataFrame, docs: DataFrame, versions: DataFrame, neighbour: int = 0) -> DataFrame:
    """Text to embed per chunk: document line, fact boundary, heading, content, neighbour tails."""
    rows = chunks.join(versions, ["document_id", "version_no"]).join(docs, "document_id")
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm'Z'"), F.lit("*"))
    start, end = F.col("effective_from"), F.col("effective_to")
    window = F.when(
        start.isNotNull() | end.isNotNull(), F.concat(F.lit(" | "), stamp(start), F.lit("~"), stamp(end))
    )
    none = F.lit("")
    head = F.concat(
        F.lit("["), "title", F.lit(" | "), "document_type", F.lit(" | v"),
        F.col("version_no").cast("string"), F.coalesce(window, none),
        F.when(~is_blank(F.col("owner")), F.concat(F.lit(" | owner:"), "owner")).otherwise(none),
        F.lit("]\n"),
        F.when(
            ~is_blank(F.col("fact_boundary")),
            F.concat(F.lit("事实边界: "), "fact_boundary", F.lit("\n")),
        ).otherwise(none),
        F.when(
            ~is_blank(F.col("section_heading")), F.concat(F.lit("## "), "section_heading", F.lit("\n"))
        ).otherwise(none),
        "content",
    )
    rows = rows.withColumn("embed_text", head)
    if neighbour > 0:
        ids = ["document_id", "version_no", "chunk_no"]
        body = java_trim(F.coalesce("content", none))
        tails = chunks.select(
            "document_id", "version_no", (F.col("chunk_no") + 1).alias("chunk_no"),
            F.substring(body, F.greatest(F.length(body) - neighbour + 1, F.lit(1)), F.lit(neighbour)).alias("_above"),
        )
        heads = chunks.select(
            "document_id", "version_no", (F.col("chunk_no") - 1).alias("chunk_no"),
            F.substring(body, F.lit(1), F.lit(neighbour)).alias("_below"),
        )
        rows = rows.join(tails, ids, "left").join(heads, ids, "left")
        above = F.when(F.col("_above") != "", F.concat(F.lit("\n[上文: "), "_above", F.lit("]")))
        below = F.when(F.col("_below") != "", F.concat(F.lit("\n[下文: "), "_below", F.lit("]")))
        rows = rows.withColumn(
            "embed_text", F.concat("embed_text", F.coalesce(above, none), F.coalesce(below, none))
        )
    return rows.select("chunk_id", "document_id", "version_no", "chunk_no", "embed_text")


def _document_marker(label: Column) -> Column:
    """What is left of a title without spaces and leading version, else a generic kind word."""
    flat = F.regexp_replace(F.lower(label), r"\s+", "")
    bare = F.regexp_replace(flat, r"^(?:\d+\.)+\d+[-_]*", "")
    result = F.lit("")
    for word in ("sop", "postmortem", "faq"):
        result = F.when(flat.contains(word), F.lit(word)).otherwise(result)
    return F.when(F.length(bare) >= 2, bare).otherwise(result)


def gold_subqueries(
    cases: DataFrame, evidence: DataFrame, docs: DataFrame, brand_prefix: str | None = None
) -> DataFrame:
    """Evaluation questions: one sub-query per requirement group, labelled with its document title.

    Groups are few per case: they come from one case's hand-written evidence.
    """
    group = F.when(
        is_blank(F.col("requirement_key")), F.concat(F.lit("__solo_"), F.col("sort_order").cast("string"))
    ).otherwise(F.col("requirement_key"))
    title = F.coalesce("title", F.lit(""))
    if brand_prefix:
        title = F.regexp_replace(title, rf"^{brand_prefix}[-\s]*", "")
    groups = (
        evidence.withColumn("group_key", group)
        .groupBy("case_key", "group_key")
        .agg(
            F.min("sort_order").alias("group_pos"),
            F.min_by("document_id", "sort_order").alias("document_id"),
        )
        .join(docs.select("document_id", "title"), "document_id", "left")
        .groupBy("case_key")
        .agg(
            F.array_sort(F.collect_list(F.struct("group_pos", java_trim(title).alias("label")))).alias(
                "groups"
            )
        )
    )
    rows = cases.join(groups, "case_key", "left").select(
        "*",
        body_of(F.col("question_text")).alias("_body"),
        scene_of(F.col("question_text")).alias("_scene"),
        F.coalesce(F.size("groups"), F.lit(0)).alias("_n"),
    )
    body, count = F.col("_body"), F.col("_n")
    by_comma = parts_of(body, "[，,]", 4)
    raw = parts_of(body, CONNECTORS, 4)
    named = F.transform(raw, identifiers)
    distinct_ids = F.forall(named, lambda x: F.size(x) > 0) & (
        F.size(F.array_distinct(F.flatten(named))) == F.size(F.flatten(named))
    )
    clauses = (
        F.when(F.size(by_comma) == count, by_comma)
        .when((F.size(raw) == count) & distinct_ids & (count >= 2), raw)
        .otherwise(split_body(body))
    )
    rows = rows.withColumns({"_clauses": clauses, "_aspect": shared_aspect(body)})

    def clause(g: Column, i: Column) -> Column:
        label, own = g["label"], F.get("_clauses", i)
        marker = _document_marker(label)
        mentions = (marker != "") & F.regexp_replace(F.lower(own), r"\s+", "").contains(marker)
        aspect = F.when(F.col("_aspect").startswith("的"), F.col("_aspect")).otherwise(
            F.concat(F.lit(" "), F.col("_aspect"))
        )
        text = (
            F.when(
                F.size("_clauses") == count,
                F.when(mentions, own).otherwise(F.concat(label, F.lit(" "), own)),
            )
            .when((count == 2) & body.rlike(CONNECTORS) & (F.col("_aspect") != ""), F.concat(label, aspect))
            .when(i < F.size("_clauses"), F.concat(label, F.lit(" "), own))
            .otherwise(F.concat(label, F.lit(" "), body))
        )
        scene = F.col("_scene")
        return F.when((scene == "") | text.startswith(scene), text).otherwise(F.concat(scene, text))

    composite = F.col("question_type").isin("CROSS_DOCUMENT", "VERSION_CONFLICT")
    chosen = (
        F.when(~composite, F.array("question_text"))
        .when(count < 2, subqueries(F.col("question_text"), F.col("question_type")))
        .otherwise(F.transform("groups", clause))
    )
    return rows.select("case_key", F.posexplode_outer(chosen).alias("sub_no", "text")).withColumn(
        "sub_no", F.col("sub_no") + 1
    )
