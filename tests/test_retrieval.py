import uuid

import numpy as np
from pyspark.sql import functions as F

from tallyvox.operators import corpus as co
from tallyvox.operators import retrieval as rt
from tallyvox.operators import search as se
from tallyvox.operators import selection as sl
from tallyvox.session import checkpoint_dir


def chunked(spark, text, **kw):
    rows = co.chunk_documents(spark.createDataFrame([(1, text)], "document_id long, text string"), **kw)
    return [(r.chunk_no, r.section_heading, r.content) for r in rows.orderBy("chunk_no").collect()]


def test_chunks(spark):
    text = "---\na: 1\n---\nintro\n# One\nbody1\n\n#### not a heading\n## Two\n" + "x" * 1500 + "\n# Empty\n"
    got = chunked(spark, text)
    assert got[0] == (1, "文档导语", "intro")
    assert got[1] == (2, "One", "body1\n\n#### not a heading")
    assert [(n, h, len(c)) for n, h, c in got[2:]] == [(3, "Two", 1000), (4, "Two", 600)]
    assert chunked(spark, "plain") == [(1, None, "plain")]
    assert chunked(spark, " \n ") == []
    assert [len(c) for _, _, c in chunked(spark, "y" * 1900)] == [1000, 1000]


def vectors(spark, n, name, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(n)], f"{name} long, embedding array<double>")


def test_search_paths_agree_with_brute_force(spark):
    q, c = vectors(spark, 23, "query_id", 1), vectors(spark, 301, "chunk_id", 2)
    small = se.vector_arm(q, c, 7).collect()
    blocks = se.vector_arm(q, c, 7, question_block=5, chunk_block=9).collect()
    as_set = lambda rows: {(r.query_id, r.chunk_id, r.rank) for r in rows}
    assert as_set(small) == as_set(blocks)
    unit = lambda rows: np.array([np.array(r.embedding) / (np.linalg.norm(r.embedding) or 1) for r in rows])
    scores = np.round(unit(q.orderBy("query_id").collect()) @ unit(c.orderBy("chunk_id").collect()).T, 9)
    want = {(i, int(j), n + 1) for i in range(23) for n, j in enumerate(sorted(range(301), key=lambda j: (-scores[i, j], j))[:7])}
    assert as_set(small) == want


def test_identical_chunks_stay_bounded(spark):
    q = vectors(spark, 2, "query_id", 1)
    same = spark.createDataFrame([(i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(5000)], "chunk_id long, embedding array<double>")
    got = se.vector_arm(q, same, 3).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in got] == [0, 1, 2, 0, 1, 2]


def test_identifiers(spark):
    chunks = spark.createDataFrame([(1, 1, 10, "t", "before", None), (1, 2, 11, "t", "see evt-2024 now", None), (1, 3, 12, "t", "after", None), (2, 1, 20, "XEVT-20245", "c", None)],
        "version_id long, chunk_no long, chunk_id long, title string, content string, lexical_text string")
    queries = spark.createDataFrame([(1, "what about EVT2024?"), (2, "none")], "query_id long, text string")
    got = rt.identifier_supplement(queries, chunks)
    assert sorted(r.chunk_id for r in got.collect()) == [10, 11, 12, 20]
    assert {r.score for r in got.collect()} == {0.12}


def test_section_grows_around_the_hit(spark):
    texts = ["a" * 400, "b" * 300, "c" * 500, "d" * 150, "e" * 300]
    chunks = spark.createDataFrame([(1, i + 1, i, t, "S") for i, t in enumerate(texts)], "version_id long, chunk_no long, chunk_id long, content string, section_heading string")
    hits = spark.createDataFrame([(1, 2)], "query_id long, chunk_id long")
    got = rt.section_expand(hits, chunks).first().snippet
    assert got == "\n".join(texts[1:4])


def test_gate(spark):
    rows = [(1, 1, 0.03, 1), (1, 2, 0.01, 2), (2, 1, 0.019, 1)]
    cands = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank int")
    qs = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: (r.outcome, r.input_count, r.injected_count) for r in rt.evidence_gate(cands, qs, F.lit(False)).collect()}
    assert got == {1: ("INJECT", 2, 1), 2: ("ABSTAIN", 1, 0), 3: ("ABSTAIN", 0, 0)}


def candidates(spark, items):
    rows = [(1, n + 1, n, d, "title " + t, None, t, 1.0 - n * 0.01, "RELEASE_NOTE") for n, (d, t) in enumerate(items)]
    return spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, document_id long, title string, section_heading string, content string, score double, document_type string")


def signals(spark, text):
    return sl.entity_signals(spark.createDataFrame([(1, text, "CROSS_DOCUMENT")], "query_id long, text string, question_type string"))


def test_coverage_brings_in_the_missing_group(spark):
    items = [(1, "alpha feature")] * 9 + [(2, "omega topic")]
    sig = signals(spark, "alpha feature list，omega topic list？")
    got = sl.coverage_select(candidates(spark, items), sig, k=4).orderBy("rank").collect()
    assert len(got) == 4 and 9 in {r.chunk_id for r in got}
    plain = sl.coverage_select(candidates(spark, items), signals(spark, "alpha").drop("question_type"), k=4).collect()
    assert [r.chunk_id for r in sorted(plain, key=lambda r: r.rank)] == [0, 1, 2, 3]


def test_quota_reserves_a_slot_per_subquery(spark):
    items = [(1, "alpha feature")] * 9 + [(2, "omega topic")]
    parts = spark.createDataFrame([(1, 1, i, i + 1) for i in range(9)] + [(1, 2, 9, 1)], "query_id long, sub_no int, chunk_id long, rank int")
    got = sl.subquery_quota(candidates(spark, items), parts, signals(spark, "alpha feature list，omega topic list？"), k=3).collect()
    assert 9 in {r.chunk_id for r in got} and 0 in {r.chunk_id for r in got}


def test_boost_moves_a_group_into_the_window(spark):
    items = [(1, "alpha feature")] * 9 + [(2, "omega topic")]
    got = sl.entity_boost(candidates(spark, items), signals(spark, "alpha feature list，omega topic list？")).orderBy("rank").collect()
    assert 9 in [r.chunk_id for r in got[:8]]


def test_rerank_penalty_against_a_plain_walk(spark):
    rng = np.random.default_rng(5)
    items = [(int(d), "t") for d in rng.integers(0, 4, 20)]
    cands = candidates(spark, items)
    relevance = {i: float(rng.random()) for i in range(20) if i % 4}
    scored = spark.createDataFrame([(1, i, s) for i, s in relevance.items()], "query_id long, chunk_id long, relevance double")
    got = [r.chunk_id for r in sl.rerank_blend(cands, scored, w=0.3, div=0.1).orderBy("rank").collect()]
    order = sorted(relevance, key=lambda i: (-relevance[i], i)) + [i for i in range(20) if i not in relevance]
    base = {c: 0.7 * (1 - n / 19) + 0.3 * (1 - c / 19) for n, c in enumerate(order)}
    want, used = [], {}
    while len(want) < 8:
        best = max((c for c in base if c not in want), key=lambda c: (base[c] - 0.1 * used.get(items[c][0], 0), -order.index(c)))
        used[items[best][0]] = used.get(items[best][0], 0) + 1
        want.append(best)
    assert got == want


def test_gold_subqueries(spark):
    cases = spark.createDataFrame([("dev-1", "CROSS_DOCUMENT", "外挂举报和暑期签到的流程是什么？"), ("dev-2", "SINGLE_DOCUMENT_FACT", "a")], "case_key string, question_type string, question_text string")
    ev = spark.createDataFrame([("dev-1", 0, 1, "g1"), ("dev-1", 1, 2, "g2"), ("dev-2", 0, 1, "")], "case_key string, sort_order int, document_id long, requirement_key string")
    docs = spark.createDataFrame([(1, "外挂举报"), (2, "春节活动")], "document_id long, title string")
    got = {(r.case_key, r.sub_no): r.text for r in rt.gold_subqueries(cases, ev, docs).collect()}
    assert got == {("dev-1", 1): "外挂举报的流程是什么", ("dev-1", 2): "春节活动 暑期签到的流程是什么", ("dev-2", 1): "a"}


def test_quota_with_a_slot_for_every_subquery(spark):
    items = [(d, f"topic{d}") for d in range(12)]
    parts = spark.createDataFrame([(1, s, s - 1, 1) for s in range(1, 9)], "query_id long, sub_no int, chunk_id long, rank int")
    text = "，".join(f"topic{d} list" for d in range(7)) + "，unmatched thing？"
    got = sl.subquery_quota(candidates(spark, items), parts, signals(spark, text), k=8).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == list(range(8))
    assert sl.coverage_select(candidates(spark, items), signals(spark, text), k=0).count() == 0


def test_clustered_vectors_are_pruned_exactly():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 24))
    vectors = np.repeat(centres, 200, axis=0) + rng.normal(size=(12_000, 24)) * 0.03
    vectors = vectors[rng.permutation(len(vectors))]
    asked = centres[rng.integers(0, 60, 300)] + rng.normal(size=(300, 24)) * 0.03
    kernel = se.CosineKernel()
    lists = lambda m: pa.array(list(m.tolist()), pa.list_(pa.float64()))
    prepared = kernel.prepare(pa.table({"query_id": pa.array(range(300)), "embedding": lists(asked)}))
    best = se.Best(300, 10)
    for a in range(0, len(vectors), 2048):
        some = lists(vectors[a : a + 2048])
        ids = np.arange(a, a + len(some))
        kernel.scan(prepared, ids, pa.RecordBatch.from_arrays([pa.array(ids), some], names=["chunk_id", "embedding"]), best)
    rows, ids, scores = best.cut()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    full = np.round(unit(asked) @ unit(vectors).T, se.SCORE_DIGITS)
    want = np.argsort(-full, axis=1, kind="stable")[:, :10]
    assert (ids.reshape(300, 10) == want).all() and (scores.reshape(300, 10) == np.take_along_axis(full, want, 1)).all()
    assert best.pairs == 300 * 12_000 and best.computed < 0.2 * best.pairs


def test_few_pairs_of_spread_vectors_are_scored_in_double_precision(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(9_000, 48))
    vectors[5000:5200] = vectors[:200]  # ties at every place
    kernel, exact = se.CosineKernel(exclude_same_id=True), []
    monkeypatch.setattr(se.np, "round", lambda x, d, whole=np.round: exact.append(np.size(x)) or whole(x, d))
    lists = lambda m: pa.array(list(m.tolist()), pa.list_(pa.float64()))
    prepared = kernel.prepare(pa.table({"query_id": pa.array(range(400)), "embedding": lists(vectors[:400])}))
    best = se.Best(400, 10)
    for a in range(0, len(vectors), 1000):
        ids, some = np.arange(a, a + 1000), lists(vectors[a : a + 1000])
        kernel.scan(prepared, ids, pa.RecordBatch.from_arrays([pa.array(ids), some], names=["chunk_id", "embedding"]), best)
    rows, ids, scores = best.cut()
    monkeypatch.undo()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    full = np.round(unit[:400] @ unit.T, se.SCORE_DIGITS)
    full[np.arange(400), np.arange(400)] = -np.inf
    want = np.argsort(-full, axis=1, kind="stable")[:, :10]
    assert (ids.reshape(400, 10) == want).all() and (scores.reshape(400, 10) == np.take_along_axis(full, want, 1)).all()
    assert sum(exact) < 0.3 * best.pairs


def test_odd_vectors_and_many_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 3)]) for k in range(300)] + [(900, [0.0] * 3), (901, None)]
    vectors = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    chunks = vectors.withColumnRenamed("query_id", "chunk_id").repartition(3)
    few = se.vector_arm(vectors, chunks, 5, exclude_same_id=True, question_block=50, chunk_block=80).collect()
    one = se.vector_arm(vectors, chunks.coalesce(1), 5, exclude_same_id=True, chunk_block=1).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, one))
    folder = f"{checkpoint_dir(spark)}/chunks-{uuid.uuid4().hex}"
    chunks.repartition(6).write.parquet(folder)
    plan = se.vector_arm(vectors, spark.read.parquet(folder), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the k best per question; chunks stay where they are
    assert se.vector_arm(vectors.limit(0), chunks, 5).count() == 0 and se.vector_arm(vectors, chunks.limit(0), 5).count() == 0


def test_cover_density(spark):
    """Covers and their ranks worked out by hand."""
    rows = [
        (1, "red apple"),  # one cover, nothing between: 0.1
        (2, "red big sour apple"),  # one cover, two words between: 0.1 / 3
        (3, "red apple red apple"),  # three covers side by side: 0.3
        (4, "red red red apple"),  # only the last red begins a cover: 0.1
        (5, "red only"),
        (6, "apple x red y z apple"),  # covers of one and of two words between: 0.1 / 2 + 0.1 / 3
        (7, None),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "Red apple? red"), (2, ""), (3, None), (4, "sour")], "query_id long, text string")
    got = [(r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in rt.legacy_lexical(asked, chunks).collect()]
    want = [(1, 3, 0.3, 1), (1, 1, 0.1, 2), (1, 4, 0.1, 3), (1, 6, 0.083333333, 4), (1, 2, 0.033333333, 5), (4, 2, 0.1, 1)]
    assert sorted(got) == sorted(want)


def test_cover_density_against_all_spans(spark):
    import random

    rng = random.Random(5)
    texts = [[rng.choice("abcdefg") for _ in range(rng.randrange(30))] for _ in range(60)]
    asked = [(1, "a"), (2, "a b"), (3, "c a b"), (4, "a b c d")]
    chunks = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "chunk_id long, content string")
    want = {}
    for q, words in asked:
        need = set(words.split())
        for k, t in enumerate(texts):
            spans = [(p, r) for p in range(len(t)) for r in range(p, len(t)) if need <= set(t[p : r + 1])]
            least = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
            if least:
                want[q, k] = round(sum(0.1 / (1 + sum(w not in need for w in t[p : r + 1])) for p, r in least), 9)
    got = rt.legacy_lexical(spark.createDataFrame(asked, "query_id long, text string"), chunks, k=100).collect()
    assert {(r.query_id, r.chunk_id): round(r.score, 9) for r in got} == want
