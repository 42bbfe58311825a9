"""Archives, whitening and conversation repair against plain versions."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvox.llm import grammar as gr
from tallyvox.llm import repair as rp
from tallyvox.llm import warc
from tallyvox.llm.whitening import whiten

PAGES = "page_id long, url string, html string, `key` string, content string, _dealt long, copies long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "c", 1, 2) for r in rows], PAGES)


def odd_pages():
    same = "copy " * 300
    return [
        (1, "http://www.Example.com:80/a?b=1#c", same),
        (2, "https://example.org/", same),
        (9, "https://example.org/z", same),
        (None, "https://example.org/none", same),
        (3, None, None),
        (4, "", ""),
        (5, "no url \r\n at all", "short"),
        (6, "http://[::1]:8080/x", "short"),
        (7, "http://10.0.0.1/é", "é" * 499 + "x"),
        (8, "http://10.0.0.1/é", "é" * 500),
        (10, "http://10.0.0.1/é", "é" * 500),
        (11, "http://b.example/", "long" * 100_000),
        (12, "http://b.example/", "twice" * 300),
        (12, "http://b.example/", "twice" * 300),
        (-1, "http://b.example/", "twice" * 300),
        (13, "http://b.example/", "\r\n\r\nWARC/1.1\r\n" * 100),
    ]


def plain_pages(rows):
    top = {}
    for page, _, html in rows:
        body = (html or "").encode()
        top[body] = max(top.get(body, page), page, key=lambda p: (p is not None, p or 0))
    out = Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        again = len(body) >= 1000 and page != top[body]
        out[page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top[body] if again else None] += 1
    return out


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rows = odd_pages()
    got = warc.write_and_read(pages(spark, rows).repartition(3)).collect()
    assert Counter(map(tuple, got)) == plain_pages(rows)
    assert warc.write_and_read(pages(spark, [])).count() == 0


def test_hot_payloads_and_hosts(spark):
    rows = [(k, "http://hot.example/", "hot" * 400) for k in range(400)]
    rows += [(1000 + k, "http://hot.example/", None) for k in range(400)]
    rows += [(2000 + k, f"http://h{k % 7}.example/{k}", f"own {k}" * 300) for k in range(400)]
    got = warc.write_and_read(pages(spark, rows).repartition(4)).collect()
    assert Counter(map(tuple, got)) == plain_pages(rows)


def test_search_in_index(spark):
    folder = warc.archive_folder(spark)
    rows = odd_pages() + [(100 + k, f"http://site{k % 9}.example/{k}", f"text {k} " * 200) for k in range(300)]
    directory = warc.build_index(warc.write_archives(pages(spark, rows), folder), folder, block_lines=7)
    assert directory.agg(F.sum("lines")).first()[0] == len(rows)
    assert directory.agg(F.max("lines")).first()[0] == 7
    wanted = spark.createDataFrame([("http://10.0.0.1/é",), ("http://site3.example/3",), ("http://site3.example/4",), (None,), ("no url \r\n at all",)], "url string")
    found = Counter((r.url, r.record_type, bytes(r.payload).decode()) for r in warc.find_captures(wanted, folder).collect())
    assert found == Counter(
        {
            ("http://10.0.0.1/é", "response", "é" * 499 + "x"): 1,
            ("http://10.0.0.1/é", "revisit", "é" * 500): 1,
            ("http://10.0.0.1/é", "response", "é" * 500): 1,
            ("http://site3.example/3", "response", "text 3 " * 200): 1,
            ("no url \r\n at all", "response", "short"): 1,
        }
    )
    read = warc.read_archives(spark, folder, payload=True).collect()
    assert sorted(bytes(r.payload).decode() for r in read) == sorted(h or "" for _, _, h in rows)


def test_damaged_archive_is_an_error(spark):
    folder = warc.archive_folder(spark)
    warc.build_index(warc.write_archives(pages(spark, [(1, "u", "text")]), folder), folder)
    line = spark.read.parquet(f"{folder}/captures").first().line.split(" ")
    fs, path = warc._storage(folder)
    other = warc._member([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Payload-Digest", "sha1:ABC")], warc._http(1) + b"y")
    with fs.open_output_stream(f"{path}/{line[4]}", compression=None) as out:
        out.write(b"\0" * int(line[5]) + other)
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archives(spark, folder).collect()


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.Example.com:80/A?b=1#c", "com,example,www)/A?b=1"),
        ("https://u:p@example.com:8443", "com,example:8443)/"),
        ("http://10.0.0.1/x y", "10.0.0.1)/x%20y"),
        ("http://[::1]/x", "[::1])/x"),
        ("mailto:a@b#c", "mailto:a@b"),
        (None, ""),
    ],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def plain_whitening(rows, components, weights):
    """vec_id -> (n, deviation, whitened up to sign, explained) in numpy, one length of vectors."""
    kept = [(k, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = [x for _, x in kept] if weights == "counts" else [list(x) for x in {tuple(x) for _, x in kept}]
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array(fit, float) - np.array(s, float) / n
    e, u = np.linalg.eigh(a.T @ a / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = []
    for k, x in kept:
        d = sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True))
        w = (np.array(x) - np.array(s) / n) @ u / np.sqrt(e)
        out += [(k, i + 1, n, d, abs(w[i]), e[i] / np.trace(a.T @ a / n)) for i in range(len(e))]
    return out


VECTORS = "vec_id long, embedding array<float>, label int, x string, copies long, d int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 0, "x", 3, 1) for k, v in rows], VECTORS)


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening(spark, weights):
    rng = np.random.default_rng(3)
    scale = np.array([3.0, 2.0, 1.0, 0.5, 0.2, 0.1])
    rows = [(k, [float(c) for c in np.float32(rng.normal(size=6) * scale)]) for k in range(300)]
    rows += [(1000 + k, rows[7][1]) for k in range(150)] + [(5, rows[5][1]), (None, rows[3][1])]
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5)]
    got = whiten(vectors(spark, rows), weights=weights).collect()
    want = plain_whitening(rows, 4, weights)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    got_rows = sorted(((r.vec_id, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in got), key=order)
    for g, w in zip(got_rows, sorted(want, key=order), strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_of_little(spark):
    assert whiten(vectors(spark, [])).count() == 0
    assert whiten(vectors(spark, [(1, None)])).count() == 0
    one = whiten(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (1, 1, "0", None, None, None), (2, 1, "0", None, None, None)] * 2
    mixed = whiten(vectors(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, [3.0]), (5, [])])).collect()
    assert Counter(r.vec_id for r in mixed) == Counter({1: 2, 2: 2, 3: 1, 4: 1})
    assert [r.whitened for r in mixed if r.vec_id in (1, 2) and r.component == 2] == [None, None]
    large = whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>"))
    n, x = 3, [2**63 - 1, -(2**63), 0]
    want = {k: (n * a - sum(x)) ** 2 + (n * b - 768) ** 2 for k, a, b in zip((1, 2, 3), x, (0, 256, 512), strict=True)}
    assert {r.vec_id: int(r.deviation) for r in large.collect()} == want


def cheapest(rows):
    """(cost, audit) over all edits by plain search, rows as (initial, fault)."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    best = {0: (0, "")}

    def put(to, state, way):
        if state not in to or way < to[state]:
            to[state] = way

    def inserted(ways):
        for _ in range(3):
            for (state, c), then in step.items():
                if c != "s" and state in ways:
                    put(ways, then, (ways[state][0] + 2, ways[state][1] + "I"))
        return ways

    for initial, fault in rows:
        best, after = inserted(best), {}
        for state, (cost, audit) in best.items():
            put(after, state, (cost + 3, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if (state, initial) in step:
                put(after, step[state, initial], (cost + extra, audit + "K"))
            for c in "ua":
                if (state, c) in step:
                    put(after, step[state, c], (cost + 2 + extra, audit + "R"))
        best = after
    best = inserted(best)
    return min(best[k] for k in (0, 3) if k in best)


def shortest_by_hand(rows):
    """The same without states: every audit up to two insertions more than turns, checked by its roles."""
    import re

    ways = []
    for size in range(len(rows) + 3):
        for audit in itertools.product("DIKR", repeat=size):
            if sum(e != "I" for e in audit) != len(rows):
                continue
            left = iter(rows)
            options, cost = [""], 0
            for e in audit:
                initial, fault = next(left) if e != "I" else ("", "")
                cost += {"D": 3, "I": 2, "K": 0, "R": 2}[e] + (e in "KR" and fault == "truncated")
                if e in "KR" and fault in ("blank", "duplicate"):
                    options = []
                add = {"D": [""], "K": [initial or "?"], "I": ["u", "a"], "R": ["u", "a"]}[e]
                options = [o + c for o in options for c in add]
            if any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                ways.append((cost, "".join(audit)))
    return min(ways)


def plain_repair(rows):
    """conv_id -> all result columns, rows as (conv_id, turn, role, text, copies)."""
    found = {r[0]: [] for r in rows}
    for conv, turn, role, text, copies in rows:
        found[conv] += [(turn, role, text)] * copies
    out = {}
    for conv, turns in found.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marks = set(), []
        for _, role, text in turns:
            body = text.strip(rp.WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marks.append((role[:1], fault))
        cost, audit = cheapest(marks)
        left, roles = iter(turns), ""
        lines = []
        for e in audit:
            _, role, text = next(left) if e != "I" else (0, "", "")
            if e == "D":
                continue
            wanted = "assistant" if roles.endswith("u") else "user"
            roles += role[0] if e == "K" else wanted[0]
            lines.append(f"{role if e == 'K' else wanted}:{text}")
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
        count = Counter(f for _, f in marks)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out.append((conv, turn, "user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1)))
    return out


def found(df):
    columns = [*rp.STATS, "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_cheapest_audits():
    rng = random.Random(4)
    faults = ["", "", "truncated", "blank", "duplicate"]
    for size in [0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 4, 4]:
        rows = [(rng.choice("suax"), rng.choice(faults)) for _ in range(size)]
        assert cheapest(rows) == shortest_by_hand(rows)


@pytest.mark.parametrize("rules", [0, 4, 200])
def test_grammar(rules):
    rng = random.Random(rules)
    sequences = ["".join(rng.choices(gr.LETTERS, [1, 1, 6, 6, 1, 1, 2, 2, 1], k=rng.choice([0, 1, 3, 9, 200]))) for _ in range(60)]
    made, own = [], gr.Grammar([])
    while len(made) < rules:
        counts = Counter(p for s in sequences for p in gr.digrams(own.symbols(s)))
        if not counts or counts.most_common(1)[0][1] < 2:
            break
        made.append(counts.most_common(1)[0][0])
        own = gr.Grammar(made)
    for s in sequences:
        rows = [("x", "blank") if c == "D" else (c.lower(), "truncated" if c.isupper() else "") for c in s]
        cost, audit = gr.finish(own.transfer(s)[: gr.STATES])
        assert (cost, "".join(gr.pieces(audit))) == cheapest(rows)
    assert gr.Grammar([(2, 3), (9, 9)]).symbols("uauaua") == [10, 9]


def test_ropes():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("DK", k=rng.randint(0, 6))) for _ in range(2))
        cut = lambda s: (s[: len(s) // 2], (s[len(s) // 2 :], ""))
        assert gr.less(cut(a), b) == (a < b)
        assert "".join(gr.pieces(cut(a))) == a


TURNS = "conv_id long, turn long, role string, text string, letters string, kind int, copies long, gaps long"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "l", 1, 5, 6) for r in rows], TURNS)


def odd_turns(seed=1):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "User"]
    texts = ["One.", "Two!", "three", "", " \t\n", None, "Same.", "Same.", "é?\x0b ", "x" * 5000, ". "]
    rows = [(c, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"own {c} {t}.") for c in range(80) for t in range(rng.randint(1, 9))]
    rows += [(None, t, "user", "Null id.") for t in range(3)] + [(200, None, "user", "a."), (200, None, "assistant", "b."), (200, 7, "user", None)]
    return rows + [(201, 3, "user", "Again.")] * 4 + [(k, 0, "user", "Only.") for k in range(300, 340)]


def test_repair(spark):
    rows = odd_turns()
    assert found(rp.damage_and_repair(turns(spark, rows).repartition(3))) == plain_repair(plain_damage(rows))
    assert rp.damage_and_repair(turns(spark, [])).count() == 0


def test_repair_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(rp, "SEGMENT", 16)
    monkeypatch.setattr(rp, "PER_ROUND", 3)
    monkeypatch.setattr(rp, "MOST_RULES", 20)
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"t{rng.randint(0, 900)}{rng.choice(['.', ''])}") for t in range(1500)]
    rows += [(2, 5, "user", "The same.")] * 700 + [(3, t, "user", "The same.") for t in range(300)]
    assert found(rp.damage_and_repair(turns(spark, rows))) == plain_repair(plain_damage(rows))


def test_given_conversations(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in given.collect()]
    assert found(rp.damage_and_repair(given)) == plain_repair(plain_damage(rows))
