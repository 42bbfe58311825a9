"""Document fingerprints: Merkle trees over sections, paragraphs and leaves, in SQL functions.

A section ends at an empty line, a paragraph at a line break. A leaf is a piece of a paragraph of at
most 64 code points: it ends at a blank behind a mark or behind one of a few letters and digits, else
after 64, so that an edit moves no cut behind the next such blank. A paragraph's hash is that of its
text, a section's that of its paragraphs' hashes, the root's that of the sections' hashes, so equal
roots mean equal texts. A fingerprint is the root and, in the shape of the tree, eight digits per
leaf: what differs between two of them locates an edit without the texts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.functions.text import bind

BLOCK = 32  # rows of a block, more where there would be over MOST_BLOCKS of them
MOST_BLOCKS = 65_536
SAMPLE = 16  # rows sampled per block to place its bounds
CUT = "\x1e"
LEAF_END = r"([.,;:!?#&*$%dlry0-9]) "
LEAF = r"[^\x1e]{1,64}"


def root(text: Column) -> Column:
    """Hash at the top of the tree."""
    sections = F.transform(
        F.split(text, "\n\n"),
        lambda s: F.sha2(F.array_join(F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256)), ""), 256),
    )
    return F.sha2(F.array_join(sections, ""), 256)


def fingerprint(text: Column) -> Column:
    """`root:` and the leaves' digits; paragraphs are parted by a comma, sections by a semicolon."""

    def paragraph(p: Column) -> Column:
        return F.array_join(
            F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda s: F.substring(F.md5(s), 1, 8)), ""
        )

    marked = F.regexp_replace(text, LEAF_END, "$1" + CUT)
    tree = F.transform(F.split(marked, "\n\n"), lambda s: F.array_join(F.transform(F.split(s, "\n"), paragraph), ","))
    return F.concat(root(text), F.lit(":"), F.array_join(tree, ";"))


def leaves(print_: Column) -> Column:
    """Leaves of a fingerprint, repeated ones with their number among equal ones; the list is made and sorted once."""

    def counted(ordered: Column) -> Column:
        starts = F.zip_with(ordered, F.concat(F.array(F.lit("")), ordered), lambda here, before: here != before)
        first = F.filter(F.transform(starts, lambda new, at: F.when(new, at)), lambda at: at.isNotNull())

        def named(first: Column) -> Column:
            ends = F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(F.size(ordered)))
            counts = F.slice(F.zip_with(first, ends, lambda x, y: y - x), F.lit(1), F.size(first))
            return F.flatten(
                F.zip_with(
                    F.array_distinct(ordered),
                    counts,
                    lambda leaf, n: F.when(n == 1, F.array(leaf)).otherwise(
                        F.transform(F.sequence(F.lit(1), n), lambda k: F.when(k == 1, leaf).otherwise(F.concat_ws("x", leaf, k)))
                    ),
                )
            )

        return F.when(F.size(F.array_distinct(ordered)) == F.size(ordered), ordered).otherwise(bind(first, named))

    return bind(
        F.sort_array(F.regexp_extract_all(F.substring(print_, 66, 1 << 30), F.lit("[0-9a-f]{8}"), F.lit(0))), counted
    )


def likeness(a: Column, b: Column, leaves_a: Column | None = None, leaves_b: Column | None = None) -> Column:
    """Share of common leaves among all of two fingerprints, repeated ones counted; 1 exactly if the roots are equal
    or all agree, 0 without leaves."""
    x, y = (leaves(a) if leaves_a is None else leaves_a), (leaves(b) if leaves_b is None else leaves_b)

    def share(x: Column, y: Column) -> Column:
        return bind(
            F.size(F.array_intersect(x, y)),
            lambda both: both.cast("double") / F.greatest(F.size(x) + F.size(y) - both, F.lit(1)),
        )

    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(
        bind(x, lambda x: bind(y, lambda y: share(x, y)))
    )


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Paragraph numbers (from 0, over all sections) of fingerprint `a` whose branch is not in `b`."""

    def paragraphs(f: Column) -> Column:
        return F.split(F.substring(f, 66, 1 << 30), "[,;]")

    old = paragraphs(b)
    at = F.transform(paragraphs(a), lambda p, k: F.when(~F.array_contains(old, p), k))
    return F.filter(at, lambda k: k.isNotNull())


def _block(at: Column, bounds: list) -> Column:
    """Number of bounds that are not above `at`, by binary search."""
    if not bounds:
        return F.lit(0)
    fields = [f"_{k}" for k in range(len(bounds[0]))]
    rows = json.dumps([dict(zip(fields, b)) for b in bounds])
    table = F.from_json(F.lit(rows), f"array<struct<{','.join(f'{f}:bigint' for f in fields)}>>")
    probe = F.struct(*(at[f].cast("bigint").alias(f) for f in fields))

    def step(low: Column, half: Column) -> Column:
        behind = low + half
        fits = (behind <= F.lit(len(bounds))) & (F.get(table, behind - 1) <= probe)
        return F.when(fits, behind).otherwise(low)

    halves = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), step)


def _with_next(docs: DataFrame) -> DataFrame:
    """(key, text, print, next, next_print): each row with the following one, keys descending, in a ring.

    Rows are cut into blocks of about 32 by rank: the bounds are taken from a sample of rows, so that
    neither far-off keys nor a key or a text that many rows share fill a block. Every text is shuffled
    once, to its block. The row behind a block's last is the first of the next block that has rows;
    only those first rows, one per block, travel again.
    """
    place = F.struct(
        F.col("key").isNull().cast("bigint").alias("_0"),
        F.coalesce(F.bitwise_not("key"), F.lit(0)).alias("_1"),
        F.xxhash64("text").alias("_2"),
        F.monotonically_increasing_id().alias("_3"),
    )
    rows = docs.withColumn("at", place)
    total = docs.count()
    blocks = min(total // BLOCK + 1, MOST_BLOCKS)
    bounds = []
    if blocks > 1:
        part = min(1.0, SAMPLE * blocks / total)
        seen = sorted(tuple(r) for r in rows.sample(part, seed=1).select("at.*").toLocalIterator())
        bounds = sorted({seen[k * len(seen) // blocks] for k in range(1, blocks)}) if seen else []
    keyed = rows.withColumn("block", _block(F.col("at"), bounds))
    placed = keyed.repartition("block")

    # at most MOST_BLOCKS numbers
    ring = Window.orderBy("block")
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    owners = keyed.select("block").distinct().select(
        "block", F.coalesce(F.lag("block").over(ring), F.last("block").over(every)).alias("owner")
    )

    inside = Window.partitionBy("block").orderBy("at")
    row = F.struct("key", "text", "print")  # with the key, so that both branches read the same exchange
    printed = placed.withColumn("print", fingerprint(F.col("text")))
    walked = printed.select("block", "key", "text", "print", F.lead(row).over(inside).alias("follow"))
    first = placed.withColumn("n", F.row_number().over(inside)).where("n = 1").join(owners, "block")
    heads = first.withColumn("print", fingerprint(F.col("text"))).select(F.col("owner").alias("block"), row.alias("head"))
    found = walked.join(heads, "block", "left").withColumn("follow", F.coalesce("follow", "head"))
    return found.select("key", "text", "print", F.col("follow.text").alias("next"), F.col("follow.print").alias("next_print"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every whole text and of its edit, with their likeness and that to the next text.

    The edit puts the first code points of the next document, keys descending, in place of the
    last half. Null texts are empty. Equal texts have equal fingerprints and likeness 1; a lone
    row is its own next; rows of one key follow each other by a hash of their text; rows without a key
    come last. Other columns are dropped. Runs a count and a sample of the keys when called.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next"), F.lit(1), half)
    )
    out = _with_next(rows).select("key", n.alias("n_chars"), edited.alias("edited"), "print", "next_print")
    out = out.withColumn("edited_print", fingerprint(F.col("edited")))
    out = out.withColumn("own", leaves(F.col("print")))
    return out.select(
        F.col("key").alias(key),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print"), F.col("own")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print"), F.col("own")).alias("near_next"),
    )


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, length(text) AS n_chars,
        coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM t),
e AS (SELECT *, substring(text, 1, n_chars - n_chars // 2) || substring(next, 1, n_chars // 2) AS edited FROM n),
p AS (SELECT *,
        sha256(list_aggregate(list_transform(string_split(text, chr(10) || chr(10)), lambda s: sha256(list_aggregate(
          list_transform(string_split(s, chr(10)), lambda x: sha256(x)), 'string_agg', ''))), 'string_agg', '')) || ':' ||
        array_to_string(list_transform(string_split(regexp_replace(text, '@END@', '\1' || chr(30), 'g'), chr(10) || chr(10)),
          lambda s: array_to_string(list_transform(string_split(s, chr(10)), lambda x: array_to_string(list_transform(
          regexp_extract_all(x, '@LEAF@'), lambda y: substring(md5(y), 1, 8)), '')), ',')), ';') AS a,
        sha256(list_aggregate(list_transform(string_split(edited, chr(10) || chr(10)), lambda s: sha256(list_aggregate(
          list_transform(string_split(s, chr(10)), lambda x: sha256(x)), 'string_agg', ''))), 'string_agg', '')) || ':' ||
        array_to_string(list_transform(string_split(regexp_replace(edited, '@END@', '\1' || chr(30), 'g'), chr(10) || chr(10)),
          lambda s: array_to_string(list_transform(string_split(s, chr(10)), lambda x: array_to_string(list_transform(
          regexp_extract_all(x, '@LEAF@'), lambda y: substring(md5(y), 1, 8)), '')), ',')), ';') AS b FROM e),
q AS (SELECT *, coalesce(lead(a) OVER (ORDER BY doc_id DESC), first_value(a) OVER (ORDER BY doc_id DESC)) AS c FROM p),
l AS (SELECT *, flatten(list_transform(map_entries(list_histogram(regexp_extract_all(a[66:], '[0-9a-f]{8}'))),
        lambda e: list_transform(range(1, e.value::BIGINT + 1), lambda k: e.key || 'x' || k))) AS la,
        flatten(list_transform(map_entries(list_histogram(regexp_extract_all(b[66:], '[0-9a-f]{8}'))),
        lambda e: list_transform(range(1, e.value::BIGINT + 1), lambda k: e.key || 'x' || k))) AS lb,
        flatten(list_transform(map_entries(list_histogram(regexp_extract_all(c[66:], '[0-9a-f]{8}'))),
        lambda e: list_transform(range(1, e.value::BIGINT + 1), lambda k: e.key || 'x' || k))) AS lc FROM q)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint,
  CASE WHEN a[:64] = b[:64] THEN 1.0::DOUBLE ELSE len(list_intersect(la, lb))::DOUBLE
    / greatest(len(la) + len(lb) - len(list_intersect(la, lb)), 1) END AS near_edited,
  CASE WHEN a[:64] = c[:64] THEN 1.0::DOUBLE ELSE len(list_intersect(la, lc))::DOUBLE
    / greatest(len(la) + len(lc) - len(list_intersect(la, lc)), 1) END AS near_next
FROM l
""".replace("@LEAF@", LEAF).replace("@END@", LEAF_END)
