"""Document corpus: chunks, versions, publishing, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.text import is_blank, java_trim
from tallyvox.operators.ordering import numbered

CHUNK_CHARS = 1000
CHUNK_OVERLAP = 100
# Fixed value: heading given to text before the first heading.
PREAMBLE_HEADING = "文档导语"

FRONT_MATTER = r"(?s)\A---\s*\n.*?\n---\s*(?:\n|$)"
_EDGE = r"[\x00-\x09\x0B-\x20]*"
_SPACE = r"[\t\x0B\f\r ]+"
HEADING_START = rf"(?dm)(?=^{_EDGE}#{{1,3}}{_SPACE}[^\n\x00-\x20])"
HEADING_LINE = rf"(?d)\A{_EDGE}#{{1,3}}{_SPACE}([^\n]*)"


def _windows(body: Column, size: int, overlap: int) -> Column:
    """The whole body when it fits, else windows that start before the previous one ends."""
    step = size - min(overlap, size - 1)
    last_start = F.length(body) - (size - step) - 1
    starts = F.sequence(F.lit(0), F.greatest(last_start, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda at: F.substring(body, at + 1, F.lit(size)))
    return F.when(F.length(body) <= size, F.array(body)).otherwise(cut)


def chunk_documents(
    docs: DataFrame,
    size: int = CHUNK_CHARS,
    overlap: int = CHUNK_OVERLAP,
    key: str = "document_id",
    text: str = "text",
) -> DataFrame:
    """Markdown sections, then windows of long sections; one projection, no shuffle.

    Documents without any text yield no rows.
    """
    content = java_trim(F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), "\r", "\n"))
    content = java_trim(F.regexp_replace(content, FRONT_MATTER, ""))
    sections = docs.filter(~is_blank(F.col(text))).select(
        key, F.split(content, HEADING_START).alias("_s")
    )
    titled = lambda part: part.rlike(HEADING_LINE)

    def section(part: Column) -> Column:
        is_titled = titled(part)
        return F.struct(
            F.when(is_titled, java_trim(F.regexp_extract(part, HEADING_LINE, 1))).alias("heading"),
            java_trim(
                F.when(is_titled, F.regexp_replace(part, HEADING_LINE, "")).otherwise(part)
            ).alias("body"),
        )

    parsed = sections.select(key, F.transform("_s", section).alias("_s"))
    any_title = F.exists("_s", lambda s: s["heading"].isNotNull())
    pieces = F.flatten(
        F.transform(
            F.filter("_s", lambda s: s["body"] != ""),
            lambda s: F.transform(
                _windows(s["body"], size, overlap),
                lambda piece: F.struct(
                    piece.alias("content"),
                    F.when(s["heading"].isNull() & F.col("_titled"), F.lit(PREAMBLE_HEADING))
                    .otherwise(s["heading"])
                    .alias("section_heading"),
                ),
            ),
        )
    )
    return (
        parsed.withColumn("_titled", any_title)
        # Outer, so that no inferred filter makes Spark cut every text twice.
        .select(key, F.posexplode_outer(pieces).alias("_pos", "_p"))
        .filter(F.col("_pos").isNotNull())
        .select(
            key,
            (F.col("_pos") + 1).alias("chunk_no"),
            F.col("_p.content").alias("content"),
            F.greatest(F.length("_p.content"), F.lit(1)).alias("token_count"),
            F.col("_p.section_heading").alias("section_heading"),
        )
    )


def html_headings_to_markdown(html: Column) -> Column:
    """Headings h1 to h3 as `#` lines, everything else reduced to its text."""
    text = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", "")
    for level in (1, 2, 3):
        text = F.regexp_replace(
            text, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n"
        )
    text = F.regexp_replace(text, r"(?i)<(p|div|br|li|article)\b[^>]*>", "\n")
    return F.regexp_replace(text, r"(?s)<[^>]*>", "")


def version_numbering(existing: DataFrame, uploads: DataFrame) -> DataFrame:
    """`uploads(document_id, upload_seq)` numbered after the document's last version."""
    last = existing.groupBy("document_id").agg(F.max("version_no").alias("_last"))
    fresh = numbered(uploads, ["document_id"], ["upload_seq"], "_n")
    return fresh.join(last, "document_id", "left").select(
        *uploads.columns, (F.coalesce("_last", F.lit(0)) + F.col("_n")).alias("version_no")
    )


def publish_state(versions: DataFrame, as_of: Column, expire_previous: bool = True) -> DataFrame:
    """Published versions with their status at `as_of`.

    With `expire_previous` a version ends when the document's next version is published.
    """
    published = versions.filter(
        F.col("published_at").isNotNull() & (F.col("published_at") <= as_of)
    )
    placed = numbered(published, ["document_id"], ["version_no"], "_n")
    after = placed.select(
        "document_id", (F.col("_n") - 1).alias("_n"), F.col("published_at").alias("_next")
    )
    joined = placed.join(after, ["document_id", "_n"], "left")
    ends = F.col("_next") if expire_previous else F.lit(None).cast("timestamp")
    in_effect = (F.col("effective_from").isNull() | (F.col("effective_from") <= as_of)) & (
        F.col("effective_to").isNull() | (F.col("effective_to") >= as_of)
    )
    return joined.select(
        "document_id",
        "version_no",
        "published_at",
        ends.alias("expired_at"),
        F.when(ends.isNotNull(), F.lit("EXPIRED")).otherwise(F.lit("PUBLISHED")).alias("status"),
        (ends.isNull() & in_effect).alias("visible"),
        F.col("_next").isNull().alias("latest"),
    )


def corpus_listing(docs: DataFrame, versions: DataFrame, ws: int, org: int | None = None) -> DataFrame:
    """Documents a workspace may see, with their versions from new to old."""
    shown = docs.filter(F.col("target_ws").isNull() | (F.col("target_ws") == ws))
    if org is not None:
        shown = shown.filter(F.col("org_id") == org)
    listed = versions.groupBy("document_id").agg(
        F.sort_array(F.collect_list(F.struct("version_no", "status")), asc=False).alias("versions")
    )
    return shown.join(listed, "document_id", "left")


def chunk_drift(chunks: DataFrame, v1: int, v2: int, prefix: int = 120) -> DataFrame:
    """Same (document, chunk number) in two versions: missing side, prefix and heading changes."""

    def side(version: int, name: str) -> DataFrame:
        return chunks.filter(F.col("version_no") == version).select(
            "document_id",
            "chunk_no",
            F.substring("content", 1, prefix).alias(f"prefix_{name}"),
            F.col("section_heading").alias(f"heading_{name}"),
            F.lit(True).alias(f"has_{name}"),
        )

    joined = side(v1, "a").join(side(v2, "b"), ["document_id", "chunk_no"], "full_outer")
    status = (
        F.when(F.col("has_b").isNull(), F.lit("missing_new"))
        .when(F.col("has_a").isNull(), F.lit("missing_old"))
        .otherwise(F.lit("present"))
    )
    return joined.select(
        "document_id",
        "chunk_no",
        status.alias("status"),
        F.coalesce(F.col("prefix_a") == F.col("prefix_b"), F.lit(False)).alias("same_prefix"),
        (~F.col("heading_a").eqNullSafe(F.col("heading_b"))).alias("heading_changed"),
    )


def substring_search(
    entries: DataFrame, queries: list[str], category: str | None = None
) -> DataFrame:
    """Entries whose title or body contains a query text, one row per query that matches."""
    rows = entries if category is None else entries.filter(F.col("category") == category)
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.col("title").contains(q) | F.col("body").contains(q), F.lit(q))
                for q in queries
            ]
        )
    )
    return rows.withColumn("query", F.explode_outer(hits)).filter(F.col("query").isNotNull())
