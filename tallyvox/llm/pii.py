"""Personal data: generated candidate spans, boosted trees on format and context, calibrated thresholds.

Base patterns define emails, ip addresses, cards and phones; what they find and their checks
accept always counts. Wider generators propose further, overlapping spans: disguised emails,
other separators, numbers with 00 or without a country. Gradient-boosted trees learn from the base spans of the
corpus, the strings of the same shape that fail the checks, and rewritten copies of both: a base
span in another notation stays personal data, one with changed digits does not. Per kind, the
smallest probability at which held-out candidates are right often enough selects what is redacted.

All distinct candidates of the corpus take part: their features are binned, equal ones are counted
together, and a level of a tree is one sum over all of them, so the driver only sees sums of fixed
size (or, where they are few, all of them). In the trees each kind and label weighs a bounded amount, thresholds count every held-out
candidate once, and a few made-up spans stand beside them, so a kind that is rare, in a small corpus or
beside many others, is selected by the same rule.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvox.llm import spans as buffers
from tallyvox.llm import tokens
from tallyvox.llm.sketch import LANES, array_rows, summed
from tallyvox.session import materialize

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000  # weight of all candidates in the trees, an eighth per kind and label at most
LARGEST = 1000  # values of features above it are told apart by nothing
SCALE = 2048  # twice the values of a feature fall below it
FEW = 1 << 16  # distinct binned examples that the driver sums itself
STEPS = 4096  # of a probability, when thresholds are found
PRIOR = 60  # made-up spans per kind that are always learned from, whatever the corpus has
PRECISION = 0.99
CONTEXT = 24

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# The same matches from starts in front of which no character of the first class stands: what fails
# from the start of such a run fails from every later place in it, so a long run is read once.
FIRST = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
}
WIDE = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]++ ?(?:@|\[ ?at ?\]|\( ?at ?\)) ?[A-Za-z0-9-]+(?: ?(?:\.|\[ ?dot ?\]|\( ?dot ?\)) ?[A-Za-z0-9-]{2,}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{0,2}[0-9]{2,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+|00 ?)?\(?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9])|(?<![0-9+.,])00[0-9]{10,15}(?![0-9])"),
}
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9]+")
_HINTS = re.compile(r"[0-9@]")


def digits_of(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind: str, span: str) -> bool:
    """The check of a base pattern's match."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p.lstrip("0")[:4] or 0) <= 255 for p in span.split("."))
    n = digits_of(span)
    if kind == "card":
        return 14 <= len(n) <= 19 and luhn(n)
    return 10 <= len(n) <= 15


def _base_matches(kind: str, text: str) -> Iterator[re.Match]:
    """Leftmost non-overlapping matches of BASE, in time linear in the text."""
    if kind not in FIRST:
        yield from BASE[kind].finditer(text)
        return
    at = 0  # behind a match the next may start within a run
    while m := BASE[kind].match(text, at) or FIRST[kind].search(text, at):
        yield m
        at = m.end()


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base matches that pass, and of those that fail."""
    good, bad = [], []
    if not _HINTS.search(text):
        return good, bad
    for k, kind in enumerate(KINDS):
        if (kind == "email" and "@" not in text) or (kind == "phone" and "+" not in text):
            continue
        for m in _base_matches(kind, text):
            (good if passes(kind, m[0]) else bad).append((m.start(), k, m.end()))
    return sorted(good), sorted(bad)


class _Covered:
    """Disjoint intervals of a text, for overlap questions in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for s, _, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        k = bisect.bisect_left(self.starts, e)
        return k > 0 and self.ends[k - 1] > s

    def add(self, s: int, e: int) -> None:
        k = bisect.bisect_left(self.starts, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)


def wide_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the wide generators that no base span overlaps; they may overlap each other."""
    out, covered = [], _Covered(taken)
    has_digit, has_at = bool(_DIGITS.search(text)), "@" in text or "[" in text or "(" in text
    for k, kind in enumerate(KINDS):
        if not (has_at if kind == "email" else has_digit):
            continue
        for m in WIDE[kind].finditer(text):
            if not covered.meets(m.start(), m.end()):
                out.append((m.start(), k, m.end()))
    return out


CUES = (
    ("mail", "contact", "write", "correo"),
    ("ip", "host", "server", "address", "addr"),
    ("card", "visa", "credit", "pay", "karte", "carte", "tarjeta"),
    ("phone", "tel", "call", "mobile", "fax", "telefon"),
)
WIDTH = 24 + len(KINDS)


def features(kind: int, span: str, before: str, after: str) -> list[float]:
    """What the trees see of a candidate: its format and what stands around it."""
    groups = [len(g) for g in _DIGITS.findall(span)]
    n = digits_of(span)
    near = {w.lower() for w in _WORD.findall(before)[-4:]}
    previous, following = before[-1:], after[:1]
    octets = [int(g) for g in _DIGITS.findall(span)[:4]] if kind == 1 else []
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(span),
        len(n),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        float(luhn(n)) if kind == 2 and n else 0.5,
        float(n[:1] in "3456") if kind == 2 else 0.5,
        max(octets, default=0),
        float(sum(o > 255 for o in octets)),
        span.count("."),
        span.count("-"),
        span.count(" "),
        sum(c in "()[]" for c in span),
        float(span.startswith("+")),
        float("@" in span),
        sum(c.isalpha() for c in span),
        len(_WORD.findall(span)[-1]) if _WORD.findall(span) else 0,
        float(previous.isalnum()),
        float(previous in ".-+/=:#\"'_"),
        float(following.isalnum()),
        float(following in "-+/=:\"'_"),
        float(any(w.startswith(CUES[kind]) for w in near)),
        sum(c.isdigit() for c in before),
        sum(c.isdigit() for c in after),
    ]


def rewritten(kind: int, span: str, salt: int) -> list[tuple[str, int]]:
    """Copies of a base span: in other notations (1), and with digits or names that make it none (0)."""
    digits = digits_of(span)
    if kind == 0:
        name, _, host = span.partition("@")
        return [
            (f"{name} [at] {host.replace('.', ' [dot] ')}", 1),
            (f"{name}(at){host.replace('.', '(dot)')}", 1),
            (f"{name} @ {host.split('.')[0]}. {name[:3]}", 0),
        ]
    if kind == 1:
        p = span.split(".")
        return [("[.]".join(p), 1), (" . ".join(p), 1), (".".join([str(300 + salt % 600), *p[1:]]), 0), (" . ".join([*p[:3], str(256 + salt % 700)]), 0)]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + salt % 9) % 10)
        by = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        off = [wrong[k : k + 4] for k in range(0, len(wrong), 4)]
        return [(".".join(by), 1), (" - ".join(by), 1), (".".join(off), 0), ("-".join(off), 0), (wrong, 0)]
    tail = digits[-10:]
    plain = f"({tail[:3]}) {tail[3:6]}-{tail[6:]}"
    return [
        (plain, 1),
        (f"00{digits}" if salt % 2 else f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", 1),
        (f"{tail[:3]}-{tail[3:5]}", 0),
        (f"{tail[:2]}/{tail[2:4]}/{tail[4:8]}", 0),
        (f"20{tail[:2]}-{tail[2:4]}-{tail[4:6]} {tail[6:8]}", 0),
        (f"{tail[:3]} {tail[3:5]} {tail[5:7]}", 0),
        (f"00{tail[:4]}", 0),
        (tail, 0),
    ]


class Trees:
    """Gradient-boosted trees of depth 3 for log loss, on at most 32 bins per feature."""

    DEPTH, ROUNDS, RATE, BINS = 3, 40, 0.2, 32

    def __init__(self, edges: list[np.ndarray], start: float):
        """A tree is (feature or -1, last bin of the lower side, value) of its nodes in heap order."""
        self.edges, self.start = edges, start
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, rows.T, strict=True)], axis=1).astype(np.uint8)

    def _leaf(self, tree: tuple, binned: np.ndarray) -> np.ndarray:
        feature, cut, _ = tree
        node, row = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.DEPTH):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 2 - (binned[row, np.maximum(f, 0)] <= cut[node]), node)
        return node

    def value(self, binned: np.ndarray) -> np.ndarray:
        return self.start + sum((t[2][self._leaf(t, binned)] for t in self.trees), np.zeros(len(binned)))

    def sums(self, tree: tuple, level: int, binned: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Slope, curvature and weight by node of the level, feature and bin."""
        p = 1 / (1 + np.exp(-self.value(binned)))
        at = self._leaf(tree, binned) - (2**level - 1)
        here = np.flatnonzero(at >= 0)
        out = np.empty((3, 2**level, binned.shape[1], self.BINS))
        for k, w in enumerate(((label - p) * weight, p * (1 - p) * weight, weight)):
            for f in range(binned.shape[1]):
                out[k, :, f] = np.bincount(at[here] * self.BINS + binned[here, f], w[here], 2**level * self.BINS).reshape(-1, self.BINS)
        return out

    def grow(self, total) -> None:
        """All trees; `total(tree, level)` is the sum of `sums` over all examples."""
        nodes = 2 ** (self.DEPTH + 1) - 1
        for _ in range(self.ROUNDS):
            tree = feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
            for level in range(self.DEPTH):
                found = total(tree, level)
                for k in range(2**level):
                    node, (gs, hs, ns) = 2**level - 1 + k, found[:, k]
                    g, h, n = gs[0].sum(), hs[0].sum(), ns[0].sum()
                    if level == 0:
                        value[0] = self.RATE * g / (h + 1)
                    if n < 20:
                        continue
                    gl, hl = np.cumsum(gs, axis=1)[:, :-1], np.cumsum(hs, axis=1)[:, :-1]
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    if gain[f, b] > 1e-3:
                        feature[node], cut[node] = f, b
                        value[2 * node + 1] = self.RATE * gl[f, b] / (hl[f, b] + 1)
                        value[2 * node + 2] = self.RATE * (g - gl[f, b]) / (h - hl[f, b] + 1)
            self.trees.append(tree)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.value(self.binned(rows))))


def prior_spans() -> list[tuple[int, int, str, str, str]]:
    """(label, kind, span, before, after) of made-up base spans and strings that fail their checks, the same for every corpus."""
    rng = np.random.default_rng(11)
    out = []
    for n in range(PRIOR):
        d = "".join(map(str, rng.integers(0, 10, 20)))
        card = next(c for c in (f"4{d[:14]}{x}" for x in range(10)) if luhn(c))
        octets = ".".join(str(x) for x in rng.integers(0, 256, 4))
        name = "".join(rng.choice(list("abcdefghiklmnoprstu"), 2 + n % 9))
        found = (
            (1, f"{name}.{d[:2]}@{name[::-1]}.example.{('com', 'org', 'net')[n % 3]}" if n % 2 else f"{name}@mail{d[:2]}.example.com"),
            (1, octets),
            (1, card if n % 3 else " ".join(card[k : k + 4] for k in range(0, 16, 4))),
            (1, f"+{1 + n % 9} ({1 + n % 8}{d[:2]}) {d[2:5]}-{d[5:9]}" if n % 2 else f"+{d[:2]} {d[2:5]} {d[5:8]} {d[8:12]}"),
            (0, name),
            (0, f"{300 + n}.{octets.split('.', 1)[1]}"),
            (0, f"{card[:-1]}{(int(card[-1]) + 1 + n % 9) % 10}"),
            (0, f"+{d[:2]} {d[2 : 5 + n % 4]}"),
        )
        for k, (label, span) in enumerate(found):
            kind = k % len(KINDS)
            if kind or label:
                before = ("", "see the text ", f"the {CUES[kind][n % len(CUES[kind])]} ", f"{CUES[kind][0]}: ")[n % 4]
                out.append((label, kind, span, before, (" of it", ".", "", ", also")[n // 4 % 4]))
    return out


def _examples(label: int, kind: int, span: str, before: str, after: str) -> list[tuple[int, int, list[float]]]:
    """(label, fold, features) of a candidate and, if it is personal data, of its rewritten copies."""
    salt = int.from_bytes(hashlib.blake2b(f"{span}|{before}".encode(), digest_size=4).digest(), "little")
    forms = [(span, label)] + (rewritten(kind, span, salt) if label else [])
    return [(y, salt % 5, np.minimum(features(kind, s, before, after), LARGEST)) for s, y in forms]


def _prior_examples() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, fold) of the made-up spans."""
    found = [e for r in prior_spans() for e in _examples(*r)]
    return np.array([e[2] for e in found], float), np.array([e[0] for e in found], float), np.array([e[1] for e in found])


def _edges(counts: np.ndarray, bins: int) -> list[np.ndarray]:
    """Bounds between bins of each feature: its values if they are few, else equally heavy parts of them; counts: features x SCALE."""
    out = []
    for own in counts:
        values = np.flatnonzero(own)
        if len(values) > bins:
            heavy = np.cumsum(own[values])
            values = np.unique(values[np.searchsorted(heavy, heavy[-1] * np.linspace(0, 1, bins + 1)[1:-1])])
        else:
            values = values[1:]
        out.append(values / 2)
    return out


class Selector:
    """Trees, and a threshold per kind from the counts of held-out examples by kind, label and probability."""

    def __init__(self, trees: Trees, held: np.ndarray):
        self.trees, self.held = trees, held
        self.thresholds = np.full(len(KINDS), np.inf)
        for k, (wrong, right) in enumerate(held):
            hit, seen = np.cumsum(right[::-1]), np.cumsum((wrong + right)[::-1])
            enough = np.flatnonzero((hit >= PRECISION * seen) & ((wrong + right)[::-1] > 0))
            if len(enough):
                self.thresholds[k] = max(0.5, (STEPS - 1 - enough[-1]) / STEPS)

    def __call__(self, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if not spans:
            return []
        rows = np.array([features(k, text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]) for s, k, e in spans], float)
        p = self.trees(rows)
        keep = sorted((-p[i], s, k, e) for i, (s, k, e) in enumerate(spans) if p[i] >= self.thresholds[k])
        chosen, covered = [], _Covered([])
        for _, s, k, e in keep:
            if not covered.meets(s, e):
                covered.add(s, e)
                chosen.append((s, k, e))
        return sorted(chosen)


def _example_rows(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(label, kind, span, before, after) of a text's base spans and strings that fail their checks."""
    good, bad = base_spans(text)
    for label, found in ((1, good), (0, bad)):
        for s, k, e in found:
            if e - s <= 80:
                yield label, k, text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]


def _held(trees: Trees, rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Examples by kind, label and step of their probability."""
    step = np.minimum((trees(rows) * STEPS).astype(np.int64), STEPS - 1)
    kind = rows[:, : len(KINDS)].argmax(axis=1)
    return np.bincount((kind * 2 + label.astype(np.int64)) * STEPS + step, weight, len(KINDS) * 2 * STEPS)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Selector:
    """Trees and thresholds from all candidates of the corpus `docs` (column text).

    `sample` bounds the weight, not the number, of the candidates: those of a kind and label weigh an
    eighth of it at most. Runs jobs: one for the candidates, one for the bins, one per level of a tree
    and one for the thresholds.
    """

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for t in batch.column("text").to_pylist() if t for r in _example_rows(t)]
            label, kind, span, before, after = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.int32()), pa.array(kind, pa.int32()), *(pa.array(c, pa.string()) for c in (span, before, after))],
                names=["label", "kind", "span", "before", "after"],
            )

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["kind"] * 2 + r["label"], n == 0, *e) for r in batch.to_pylist() for n, e in enumerate(_examples(**r))]
            stratum, own, label, fold, seen = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c, pa.int32()) for c in (stratum, label, fold)),
                    pa.array(own, pa.bool_()),
                    pa.array([np.asarray(f, "<f4").tobytes() for f in seen], pa.binary()),
                ],
                names=["stratum", "label", "fold", "own", "features"],
            )

    candidates = docs.select("text").mapInArrow(examples, "label int, kind int, span string, before string, after string").distinct()
    counted = materialize(
        candidates.mapInArrow(featured, "stratum int, label int, fold int, own boolean, features binary")
        .groupBy("stratum", "label", "fold", "own", "features")
        .agg(F.count("*").alias("n"))
    )
    many = {r["stratum"]: r["n"] for r in counted.where("own").groupBy("stratum").agg(F.sum("n").alias("n")).collect()}
    share = np.ones(2 * len(KINDS))
    for stratum, n in many.items():
        share[stratum] = min(1.0, sample / (2 * len(KINDS)) / n)

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(features, label, number, weight in the trees)."""
        rows = buffers.buffer(batch.column("features"))[0].view("<f4").reshape(-1, WIDTH).astype(float)
        n = batch.column("n").to_numpy().astype(float)
        return rows, batch.column("label").to_numpy().astype(float), n, n * share[batch.column("stratum").to_numpy()]

    def added(local: np.ndarray, of: DataFrame, one) -> np.ndarray:
        """`local` and the sum of `one(batch)` over all batches."""
        bits = int(np.ceil(np.log2(local.size)))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total, some = np.zeros(1 << bits), False
            for batch in batches:
                if batch.num_rows:
                    total[: local.size] += one(batch).ravel()
                    some = True
            if some:
                yield array_rows(total, bits, TaskContext.get().partitionId() % LANES)

        found = summed(of.mapInArrow(add, "shard int, lane int, counts binary"), bits, np.dtype("<f8"))
        return local + found[: local.size].reshape(local.shape)

    def spread(rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Weight of every value of the features, and behind them that of either label."""
        out = np.zeros((WIDTH + 1, SCALE))
        for f in range(WIDTH):
            out[f] = np.bincount((2 * rows[:, f]).astype(np.int64), weight, SCALE)
        out[WIDTH, :2] = np.bincount(label.astype(np.int64), weight, 2)
        return out

    def spread_of(batch: pa.RecordBatch) -> np.ndarray:
        rows, label, _, weight = columns(batch)
        return spread(rows, label, weight)

    rows, label, fold = _prior_examples()
    ones, learned = np.ones(len(rows)), fold > 0
    values = added(spread(rows[learned], label[learned], ones[learned]), counted.where("fold > 0"), spread_of)
    no, yes = values[WIDTH, :2]
    trees = Trees(_edges(values[:WIDTH], Trees.BINS), float(np.log((yes + 1) / (no + 1))))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                seen, own, _, weight = columns(batch)
                parts = trees.binned(seen), own, weight
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["binned", "label", "weight"])

    def arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(row["binned"], np.uint8).reshape(-1, WIDTH), np.frombuffer(row["label"]), np.frombuffer(row["weight"])

    table = counted.where("fold > 0")
    few = table.count() <= FEW
    blocks = materialize(table.mapInArrow(block, "binned binary, label binary, weight binary"))
    here = [(trees.binned(rows[learned]), label[learned], ones[learned])]
    if few:
        here += map(arrays, blocks.collect())
    blocks = blocks.rdd.map(arrays).cache()

    def total(tree: tuple, level: int) -> np.ndarray:
        found = sum(trees.sums(tree, level, *b) for b in here)
        return found if few else found + blocks.map(lambda b: trees.sums(tree, level, *b)).treeReduce(np.add)

    trees.grow(total)
    blocks.unpersist()
    held = ~learned

    def held_of(batch: pa.RecordBatch) -> np.ndarray:
        seen, own, n, _ = columns(batch)
        return _held(trees, seen, own, n)

    counts = added(_held(trees, rows[held], label[held], ones[held]), counted.where("fold = 0"), held_of)
    return Selector(trees, counts.reshape(len(KINDS), 2, STEPS))


def personal_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, keep: bool = False
) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base, spans, redacted) of every whole text.

    `base` and `spans` are arrays of (start, kind, end) in code points, end exclusive, by start and
    then kind; kind counts from 0 in the order of KINDS. `spans` holds all base spans and what the
    trees add; in `redacted` every span is replaced by its kind in brackets, overlapping ones by the
    first. Null and empty texts have no spans, and null and empty redactions. A null key and
    repeated rows are kept as they are; other columns are dropped; `keep` adds the struct `row` of
    all of them. Runs a job when called.
    """
    spark = docs.sparkSession
    tokens.arrow_batches(spark)
    row = [F.struct("*").alias("row")] if keep else []
    texts = docs.select(F.col(key).alias("key"), *row, F.col(text).alias("text"))
    select = spark.sparkContext.broadcast(fit(texts, sample))
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, every, clean = [], [], [], []
            for t in batch.column("text").to_pylist():
                good, _ = base_spans(t or "")
                added = select.value(t, wide_spans(t, good)) if t else []
                both = sorted(good + added)
                counts.append([sum(k == n for _, k, _ in good) for n in range(len(KINDS))])
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in good])
                every.append([{"start": s, "kind": k, "end": e} for s, k, e in both])
                clean.append(redact(t, both))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.drop_columns(["text"]).columns,
                    *(pa.array([c[n] for c in counts], pa.int64()) for n in range(len(KINDS))),
                    pa.array(base, span),
                    pa.array(every, span),
                    pa.array(clean, pa.string()),
                ],
                names=[*batch.schema.names[:-1], *(f"n_{k}" for k in KINDS), "base", "spans", "redacted"],
            )

    one = T.ArrayType(T.StructType().add("start", T.LongType()).add("kind", T.IntegerType()).add("end", T.LongType()))
    shape = T.StructType(texts.drop("text").schema.fields)
    for k in KINDS:
        shape = shape.add(f"n_{k}", T.LongType())
    found = texts.mapInArrow(find, shape.add("base", one).add("spans", one).add("redacted", T.StringType()))
    return found.withColumnRenamed("key", key)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if not text or not spans:
        return text
    parts, at = [], 0
    for s, k, e in spans:
        if s >= at:
            parts += [text[at:s], f"[{KINDS[k].upper()}]"]
        elif e > at:
            pass  # the tail of an overlapping span goes with the first
        at = max(at, e)
    return "".join([*parts, text[at:]])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def span_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per kind, a digest of the base spans and the list of all spans."""
    found = personal_spans(docs, key, text)
    return found.select(
        key, "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
