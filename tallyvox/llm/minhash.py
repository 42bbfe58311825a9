"""Near duplicates by an inverted index of MinHash signature coordinates.

A text is the set of its distinct five-word shingles. A signature holds, per coordinate, the
smallest hash of the set under that coordinate's function. Two texts of similarity s agree in a
coordinate with probability s, so pairs above the threshold agree in at least `matches` of them
(4.8 standard deviations below the mean). Such a pair shares one of the `coordinates - matches + 1`
rarest coordinate-value pairs of either text, which are the only ones a text is posted under; the
frequent rest of the lists is skipped and only looked up, when the collisions of a candidate are
counted. Candidates that agree often enough are confirmed on the full sets.

Texts of one set are one entry. Members of a list are not paired with each other at first: they are
compared with the list's leaders, and what the confirmed links connect is never compared again. The
pairs between components that remain are then compared in full, block by block inside tasks, so
nothing is lost to a cap and only similar pairs become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.llm import spans, tokens
from tallyvox.llm.components import components
from tallyvox.llm.sketch import bucket_counts
from tallyvox.session import materialize, release

SHINGLE = 5
COORDINATES = 64
SKETCH_BITS = 20
BLOCK_ROWS = 1024  # members of a list that one task compares with as many others
BLOCK_SHINGLES = 1 << 19
LEADERS = 3  # members every other one of a list is compared with first
_SEEDS = np.random.Generator(np.random.PCG64(64)).integers(0, 1 << 64, (3, 256), dtype=np.uint64)
_SHIFT, _FACTOR, _PLACE = _SEEDS[0], _SEEDS[1] | np.uint64(1), _SEEDS[2] | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text; fewer words are one shingle."""
    for a, b in spans.byte_groups(offsets):
        part = spans.lowered(data[offsets[a] : offsets[b]])
        starts, ends, first = spans.words(part, offsets[a : b + 1] - offsets[a])
        word = spans.hashes(part, starts, ends)
        n = max(len(word) - SHINGLE + 1, 0)
        run = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            run += word[k : k + n] * _PLACE[k]
        run = spans.mix(run)
        for k in range(b - a):
            s, e = first[k], first[k + 1]
            if e - s >= SHINGLE:
                yield np.unique(run[s : e - SHINGLE + 1])
            elif e > s:
                yield spans.mix(np.array([(word[s:e] * _PLACE[: e - s]).sum(dtype=np.uint64) + np.uint64(e - s)]))
            else:
                yield np.zeros(0, np.uint64)


def signature(members: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Smallest hash per coordinate, its upper 32 bits."""
    best = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(members), 2048):
        hashed = (members[a : a + 2048, None] ^ _SHIFT[:coordinates]) * _FACTOR[:coordinates]
        np.minimum(best, hashed.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, coordinates: int = COORDINATES) -> int:
    """Coordinates a pair at the threshold agrees in, but for 4.8 standard deviations."""
    return max(1, math.floor(coordinates * threshold - 4.8 * math.sqrt(coordinates * threshold * (1 - threshold))))


def _coordinate_keys(signatures: np.ndarray) -> np.ndarray:
    place = np.arange(signatures.shape[1], dtype=np.uint64) << np.uint64(32)
    return spans.mix(signatures.astype(np.uint64) + place)


def _signed(docs: DataFrame) -> DataFrame:
    """(key, set_a, set_b, n_shingles, signature); set_a, set_b: 128 bits that name the set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for members in shingle_sets(*spans.buffer(batch.column("text"))):
                name = [int(x.view(np.int64)) for x in (spans.mix(members).sum(), spans.mix(members ^ _SHIFT[0]).sum())]
                rows.append((*name, len(members), signature(members).tobytes()))
            a, b, n, s = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.binary())],
                names=["key", "set_a", "set_b", "n_shingles", "signature"],
            )

    return docs.mapInArrow(sign, "key long, set_a long, set_b long, n_shingles long, signature binary")


def _rows_of(batch: pa.RecordBatch, column: str = "signature") -> np.ndarray:
    return spans.buffer(batch.column(column))[0].view("<u4").reshape(-1, COORDINATES)


def _posted(entries: DataFrame, prefix: int) -> DataFrame:
    """(list, id, size, central): entries under the rarest coordinate-value pairs of their signatures.

    Lists of one entry are left out. `central` is higher the more often the entry's coordinates
    occur in the corpus: the text that copies were made from comes before its copies.
    """

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return _coordinate_keys(_rows_of(batch)).ravel()

    counts = entries.sparkSession.sparkContext.broadcast(bucket_counts(entries, "signature", SKETCH_BITS, keys))

    def often(found: np.ndarray) -> np.ndarray:
        return counts.value[(found & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _coordinate_keys(_rows_of(batch))
            order = np.lexsort((found, often(found)), axis=1)[:, :prefix]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.take_along_axis(found, order, 1).ravel().view(np.int64)),
                    pa.array(np.repeat(batch.column("id").to_numpy(), prefix)),
                ],
                names=["list", "id"],
            )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            central = np.log1p(often(_coordinate_keys(_rows_of(batch)))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("size"), pa.array(central)], names=["id", "size", "central"])

    posts = entries.select("id", "signature").mapInArrow(post, "list long, id long")
    shared = posts.groupBy("list").agg(F.count("*").alias("n")).where("n > 1").select("list")
    posts = materialize(posts.join(shared, "list"))
    weighed = entries.select("id", "size", "signature").mapInArrow(weigh, "id long, size long, central double")
    return posts.join(weighed, "id")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, members) of the wanted ids, hashed again from their texts.

    A bit table of fixed size drops most other texts before anything is shuffled.
    """
    bits = 21
    flags = docs.sparkSession.sparkContext.broadcast(
        np.packbits(bucket_counts(wanted.select(F.xxhash64("id").alias("h")), "h", bits) > 0)
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (batch.column("h").to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.int64)
            batch = batch.filter(pa.array((flags.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            rows = [m.tobytes() for m in shingle_sets(*spans.buffer(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, pa.binary())], names=["id", "members"])

    hashed = docs.where("key is not null").select("key", "text", F.xxhash64("key").alias("h")).mapInArrow(members, "id long, members binary")
    return hashed.join(wanted, "id", "left_semi")


def _confirmed(
    pairs: DataFrame, entries: DataFrame, texts: DataFrame, share: int, matches: int, sets: DataFrame | None = None
) -> DataFrame:
    """Pairs (a, b) that agree in enough coordinates and are similar on their full sets.

    `sets` may hold the sets of all entries concerned; otherwise those needed are hashed again.
    """

    def agreeing(batch: pa.RecordBatch) -> np.ndarray:
        return (_rows_of(batch, "signature_a") == _rows_of(batch, "signature_b")).sum(axis=1) >= matches

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(agreeing(batch)))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "signature_a" in batch.schema.names:
                batch = batch.filter(pa.array(agreeing(batch)))
            keep = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= share * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def both_ends(of: DataFrame, table: DataFrame) -> DataFrame:
        columns = [c for c in table.columns if c != "id"]
        for end in "ab":
            of = of.join(table.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
        return of.select("a", "b", *(f"{c}_{end}" for c in columns for end in "ab"))

    signed = entries.select("id", "signature")
    if sets is not None:
        return materialize(both_ends(pairs, signed.join(sets, "id")).mapInArrow(similar, "a long, b long"))
    close = materialize(both_ends(pairs, signed).mapInArrow(agree, "a long, b long"))
    if close.isEmpty():
        return close
    release(pairs.sparkSession)
    sets = materialize(_sets(texts, close.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    return materialize(both_ends(close, sets).mapInArrow(similar, "a long, b long"))


def _led(posts: DataFrame) -> DataFrame:
    """(posts, first, led): every post with each leader of its list; led: it is one itself.

    The most central member leads, and two more by a hash.
    """
    ranks = [F.struct("central", "id"), *(F.struct(F.xxhash64("id", F.lit(k)), "id") for k in range(1, LEADERS))]
    leaders = posts.groupBy("list").agg(*(F.max_by(F.struct("id", "size"), r).alias(f"l{k}") for k, r in enumerate(ranks)))
    leaders = leaders.select("list", F.array_distinct(F.array(*(f"l{k}" for k in range(LEADERS)))).alias("leaders"))
    met = posts.join(leaders, "list").withColumn("led", F.exists("leaders", lambda x: x["id"] == F.col("id")))
    return met.select(*posts.columns, "led", F.explode("leaders").alias("first"))


def _lead(
    posts: DataFrame, links: DataFrame | None, entries: DataFrame, texts: DataFrame, share: int, matches: int, sets: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(links, posts left): links between leaders and members added; posts whose list is not in one component yet."""
    led = _led(posts)
    apart = "id <> first.id" + (" and component <> first_component" if "component" in posts.columns else "")
    if "component" in posts.columns:
        of = posts.select(F.col("id").alias("first_id"), F.col("component").alias("first_component")).distinct()
        led = led.withColumn("first_id", F.col("first.id")).join(of, "first_id").drop("first_id")
    pairs = (
        led.where(apart)
        .select("size", F.col("first.size").alias("other"), F.greatest("first.id", "id").alias("a"), F.least("first.id", "id").alias("b"))
        .where(_close_sizes(share))
        .select("a", "b")
        .distinct()
    )
    found = _confirmed(pairs, entries, texts, share, matches, sets)
    links = found if links is None else links.unionByName(found)
    release(posts.sparkSession)
    # a leader has met every member of its list and leaves it
    columns = [c for c in posts.columns if c != "component"]
    return links, materialize(_placed(led.where("not led").select(columns).distinct(), links))


def _placed(posts: DataFrame, links: DataFrame) -> DataFrame:
    """Posts with the component their entry is in so far, without lists inside one component."""
    named = posts.join(components(links, rounds=1).withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    split = named.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return named.join(split.select("list"), "list")


def _close_sizes(share: int) -> str:
    return f"100 * least(size, other) >= {share} * greatest(size, other)"


def near_duplicates(docs: DataFrame, share: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept): groups of texts whose shingle similarity is share/100 or more.

    Words are maximal runs without ASCII white space, A-Z lowered. component_id is the smallest
    key reachable over links, kept marks the row that has it. Null and empty texts link with
    nothing; equal short texts do. Rows of one key are one document, with the links of all of
    them. A row without a key is its own group: null component_id, kept. Other columns are
    dropped. Runs jobs when called.
    """
    tokens.arrow_batches(docs.sparkSession)
    matches = least_matches(share / 100)
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = materialize(_signed(texts))
    usable = signed.where("n_shingles > 0 and key is not null")
    entries = materialize(
        usable.groupBy("set_a", "set_b")
        .agg(F.min("key").alias("id"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature"))
        .groupBy("id", "signature")
        .agg(F.max("size").alias("size"), F.min("set_a").alias("set_a"))
    )
    posts = materialize(_posted(entries, COORDINATES - matches + 1))
    active = entries.join(posts.select("id").distinct(), "id", "left_semi")

    links, left = _lead(posts, None, active, texts, share, matches)
    if not left.isEmpty():
        # what has few shingles of its own leads next
        sets = materialize(_sets(texts, left.select("id").distinct()))
        bounded = _bounded(left, sets, share)
        links, left = _lead(bounded.withColumn("central", F.col("common") / F.col("size")), links, active, texts, share, matches, sets)
        links = links.unionByName(_across(left, sets, share))

    named = components(links.unionByName(_same_set_links(usable)))
    return (
        signed.join(named.withColumnRenamed("node", "key"), "key", "left")
        .select(
            F.col("key").alias(key),
            "n_shingles",
            F.coalesce("component", "key").alias("component_id"),
            F.coalesce(F.col("key") == F.coalesce("component", "key"), F.lit(True)).alias("kept"),
        )
    )


def _bounded(posts: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Posts with `common`, the number of shingles any other entry of these posts has too.

    No pair shares more than the smaller `common` of the two. Entries for which that rules out every
    other of a list, were it as short as the list's shortest, leave the list: copies that each have
    enough changes of their own are not compared with all other copies.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = spans.buffer(batch.column("members"))
            ids = np.repeat(batch.column("id").to_numpy(), np.diff(offsets) // 8)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(data.view(np.int64))], names=["id", "shingle"])

    owned = sets.mapInArrow(spread, "id long, shingle long").groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    alone = owned.where("id = other").groupBy("id").agg(F.count("*").alias("alone"))
    bounded = posts.join(alone, "id", "left").withColumn("common", F.col("size") - F.coalesce("alone", F.lit(0))).drop("alone")
    short = bounded.groupBy("list").agg(F.min("size").alias("least"))
    return materialize(bounded.join(short, "list").where(f"100 * common >= {share} * (size + least - common)").drop("least"))


def _across(posts: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Similar pairs of a list's members that lie in different components, found on the full sets.

    A list is dealt into blocks of bounded rows and bytes, and one task compares two blocks with each
    other, so pairs that are not similar never become rows. Members of the list's largest component
    have blocks of their own, which only meet those of the members outside it.
    """
    weight = posts.groupBy("list", "component").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    by = F.struct("n", "component")
    lists = weight.groupBy("list").agg(
        F.max_by("component", by).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"),
        F.max_by("n", by).alias("main_n"), F.max_by("s", by).alias("main_s"),
    )

    def blocks(n: str, s: str) -> Column:
        return F.expr(f"cast(greatest(1, ceil(({n}) / {BLOCK_ROWS}), ceil(({s}) / {BLOCK_SHINGLES})) as int)")

    lists = lists.select("list", "main", blocks("n - main_n", "s - main_s").alias("few"), blocks("main_n", "main_s").alias("many"))
    dealt = F.xxhash64("id", F.lit(7))
    outside = F.col("component") != F.col("main")
    placed = posts.select("list", "id", "component").join(lists, "list").select(
        "list", "id", "component",
        F.when(outside, F.pmod(dealt, "few")).otherwise(F.col("few") + F.pmod(dealt, "many")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.when(outside, F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)).alias("other"),
    )
    met = placed.select(
        "list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component"
    ).join(sets, "id")

    def compare(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        ids, group = table.column("id").to_numpy(), table.column("component").to_numpy()
        found = [np.frombuffer(m.as_buffer(), "<u8") for m in table.column("members")]
        x, y = np.flatnonzero(block == table.column("i")[0].as_py()), np.flatnonzero(block == table.column("j")[0].as_py())
        size = np.array([len(m) for m in found])
        both = _common([found[k] for k in x], [found[k] for k in y])
        alike = 100 * both >= share * (size[x][:, None] + size[y][None, :] - both)
        r, c = np.nonzero(alike & (group[x][:, None] != group[y][None, :]))
        u, v = ids[x[r]], ids[y[c]]
        return pa.table({"a": np.minimum(u, v), "b": np.maximum(u, v)})

    return materialize(met.groupBy("list", "i", "j").applyInArrow(compare, "a long, b long").distinct())


def _common(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of `one` with every set of `other`."""
    both = np.zeros((len(one), len(other)))
    if not one or not other:
        return both
    words = np.intersect1d(np.concatenate(one), np.concatenate(other))

    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(words, flat)
        known = np.flatnonzero(words[np.minimum(at, len(words) - 1)] == flat) if len(words) else np.zeros(0, np.int64)
        order = known[np.argsort(at[known], kind="stable")]
        return rows[order], at[order]

    (xr, xw), (yr, yw) = entries(one), entries(other)
    for a in range(0, len(words), 4096):
        part = []
        for rows, at, n in ((xr, xw, len(one)), (yr, yw, len(other))):
            low, high = np.searchsorted(at, [a, a + 4096])
            flags = np.zeros((n, 4096), np.float32)
            flags[rows[low:high], at[low:high] - a] = 1
            part.append(flags)
        both += part[0] @ part[1].T
    return both


def _same_set_links(usable: DataFrame) -> DataFrame:
    sets = usable.select("set_a", "set_b", "key")
    least = sets.groupBy("set_a", "set_b").agg(F.min("key").alias("id"))
    return sets.join(least, ["set_a", "set_b"]).where("key <> id").select(F.col("key").alias("a"), F.col("id").alias("b"))
