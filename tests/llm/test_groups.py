"""Near duplicates of texts and vectors, and fingerprints, against brute force."""

import re

import numpy as np
import pytest

from tallyvox.llm import minhash
from tallyvox.llm.components import components
from tallyvox.llm.embeddings import embedding_groups, product, quantize
from tallyvox.llm.fingerprints import fingerprints
from tallyvox.llm.minhash import near_duplicates

from .conftest import prose


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def grouped(rows, share):
    """Component per key by comparing all pairs."""
    sets = [(k, shingles(t)) for k, t in rows if k is not None]
    up = {k: k for k, _ in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= share * len(x | y):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return {k: top(k) for k in up}


def compare(docs, share):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, got = grouped(rows, share), near_duplicates(docs, share).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    sizes = sorted((r.doc_id or 0, r.n_shingles) for r in got)
    assert sizes == sorted((k or 0, len(shingles(t))) for k, t in rows)


@pytest.mark.parametrize("share", [80, 85])
def test_near_duplicates(odd, small, none, share):
    compare(odd, share)
    compare(small, share)
    assert near_duplicates(none, share).count() == 0


def copies(spark, n=60):
    """Copies of a text at all distances from each other, about half of which link directly."""
    rng = np.random.default_rng(5)
    base = prose(77, 200).split(" ")
    rows = []
    for k in range(n):
        words = list(base)
        for at in rng.choice(len(words), 1 + k % 5, replace=False):
            words[at] = f"w{rng.integers(1 << 30)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, prose(500 + k, 60)) for k in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("share", [80, 85])
@pytest.mark.parametrize("leaders", [1, 3])
def test_every_link_between_copies(spark, monkeypatch, leaders, share):
    monkeypatch.setattr(minhash, "LEADERS", leaders)
    compare(copies(spark), share)


def test_unlike_copies_are_compared_inside_tasks(spark, monkeypatch):
    """Copies with changes others share, few of them similar: pairs across components never become rows."""
    rng, base, n = np.random.default_rng(8), prose(78, 240).split(" "), 60
    texts = []
    for k in range(n):
        words = list(base)
        for at in rng.choice(range(0, 240, 6), 12, replace=False):
            words[at] = "other"
        texts.append((k, " ".join(words)))
    offered, confirmed = [], minhash._confirmed
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *more: offered.append(pairs.count()) or confirmed(pairs, *more))
    compare(spark.createDataFrame(texts, "doc_id long, text string"), 80)
    assert len(offered) == 2  # members with leaders, twice


def test_common_counts_are_set_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, n)).astype(np.uint64) for n in (0, 1, 40, 3000, 6000, 6000)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets[1:]]
    assert minhash._common(sets[1:], sets).tolist() == want and minhash._common([], sets).shape == (0, 6)


def test_few_rounds_never_join_too_much(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 40)], "a long, b long")
    few = {r.node: r.component for r in components(chain, rounds=1).collect()}
    assert set(few) == set(range(1, 41)) and len(components(chain, rounds=1).collect()) == 40
    assert set(components(chain).select("component").distinct().collect()[0]) == {1}


def test_candidates_are_few_for_unlike_texts(spark):
    rows = [(k, prose(k, 80)) for k in range(60)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80)
    assert found.where("not kept").count() == 0


def test_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (3, 1), (1, 2), (5, 5), (6, 9), (20, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {6: 6, 7: 6, 8: 6, 9: 6, 1: 1, 2: 1, 3: 1, 20: 1}


def test_quantised_bound_is_rigorous():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 64)) * np.exp(rng.normal(size=(200, 1)) * 5)
    unit, small, scale, error = quantize(x)
    near = product(small, small) * scale[:, None] * scale
    bound = error[:, None] + (1 + error[:, None]) * error
    assert (np.abs(near - unit @ unit.T) <= bound + 1e-5).all()
    assert (product(small, small) == small.astype(int) @ small.astype(int).T).all()


def vectors(spark):
    rng = np.random.default_rng(2)
    rows, centre = [], rng.normal(size=(6, 16))
    for k in range(150):
        v = centre[k % 6] + rng.normal(size=16) * 0.32
        rows.append((k, [float(x) for x in v], 0))
    rows += [(200, rows[3][1], 1), (201, rows[3][1], 1), (202, [2 * x for x in rows[3][1]], 1), (-5, rows[40][1], 1), (200, rows[3][1], 1)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [1.0, None] + [0.0] * 14, 0), (304, [float("nan")] * 16, 0), (305, [float("inf")] * 16, 0)]
    rows += [(306, [1.0, 0.0], 0), (307, [1.0, 0.1], 0), (None, rows[3][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component_id int")


@pytest.mark.parametrize("tile", [16, 4096])
def test_embeddings(spark, monkeypatch, tile):
    from tallyvox.llm import embeddings

    monkeypatch.setattr(embeddings, "TILE", tile)
    df = vectors(spark)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    good = [(k, np.array(v, float)) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, up = {}, {k: k for k, _ in good}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, x) in enumerate(good):
        links[i] = 0
        for j, (b, y) in enumerate(good):
            if i != j and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9:
                links[i] += 1
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    want = sorted((k, links[i], top(k), k == top(k)) for i, (k, _) in enumerate(good))
    want += [(k, 0, k, True) for k, v in rows if k is None or k in (300, 301, 302, 303, 304, 305)]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_groups(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_embeddings_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_groups(none).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embedding_groups(bad).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_fingerprints(spark, odd, none):
    import hashlib

    got = fingerprints(odd).collect()
    rows = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1].encode()))
    order += [r for r in rows if r[0] is None]
    want = []
    for (k, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want.append((k, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        if r.doc_id is not None:
            by_text.setdefault(dict((k, t) for k, t in rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values()) and len({min(f) for f in by_text.values()}) == len(by_text)
    assert fingerprints(none).count() == 0
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert fingerprints(one).first().near_next == 1.0


def test_edit_is_located(spark):
    from pyspark.sql import functions as F

    from tallyvox.llm.fingerprints import changed_paragraphs, fingerprint

    df = spark.createDataFrame([("a b. c\nd e\n\nf g", "a b. c\nd X\n\nf g")], "x string, y string")
    assert df.select(changed_paragraphs(fingerprint(F.col("x")), fingerprint(F.col("y")))).first()[0] == [1]


def test_fingerprints_of_skewed_keys(spark):
    """A far-off key, a key of a third of the rows and equal rows spread over blocks; the ring stays whole."""
    from tallyvox.llm import fingerprints as module

    rows = [(k, f"text {k}") for k in range(1000)] + [(10**12, "far")]
    rows += [(500_000, f"same key {k}") for k in range(300)] + [(600_000, "equal row")] * 300
    df = spark.createDataFrame(rows, "key long, text string").repartition(3, "text")
    got = module._with_next(df).select("key", "text", "next").collect()
    assert sorted((r.key, r.text) for r in got) == sorted(rows)
    assert sorted(r.next for r in got) == sorted(t for _, t in rows)
    follow = {(r.key, r.text): r.next for r in got if r.key < 1000 and r.key > 0}
    assert all(n == f"text {k - 1}" for (k, _), n in follow.items())
    assert next(r.next for r in got if r.key == 10**12) == "equal row"
    assert sum(r.next == "equal row" for r in got if r.text == "equal row") == 299
    assert next(r.next for r in got if r.key == 0) == "far"


def test_blocks_are_bounded_for_any_keys(spark):
    from pyspark.sql import functions as F

    from tallyvox.llm.fingerprints import _block

    bounds = [(k, k % 2) for k in range(0, 40, 2)]
    df = spark.range(-3, 50).select(F.struct(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).alias("at"))
    named = df.select("at.a", _block(F.struct(F.col("at.a").alias("_0"), F.col("at.b").alias("_1")), bounds).alias("n"))
    assert all(r.n == sum(b <= (r.a, 0) for b in bounds) for r in named.collect())


def test_likeness_of_texts_without_marks(spark):
    """Lists of words, scripts without blanks and repeated sentences keep what an edit leaves alone."""
    import random

    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = " ".join("".join(rng.choices(letters, k=6)) for _ in range(200))
    script = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(900))
    same = "One sentence that is repeated. " * 60
    junk = "".join(rng.choices(letters, k=4000))
    rows = [(k, t) for k, t in enumerate([words, script, same, junk])]
    for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.near_edited > 0.2 and r.near_edited > r.near_next
        assert max(len(p) for p in r.fingerprint[65:].replace(";", ",").split(",")) > 8 * 10
