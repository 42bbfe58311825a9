"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Word vectors are learned from the whole corpus: a word's vector is the sum of the sparse random
index vectors of its neighbours, up to two words away. Words share 2^14 hashed places, so the
table has a fixed size. Word forms (case, marks, length, repetition) have vectors of their own, by
the same rule. A document is the mean and spread of its words' and forms' vectors. The network is
fitted on a bounded sample of labelled rows, and a temperature on rows it was not fitted on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvox.llm import spans, tokens
from tallyvox.llm.sketch import LANES, array_rows, summed

PLACE_BITS = 14
DIM_BITS = 5
DIM = 1 << DIM_BITS
NONZERO = 4
REACH = 2
SAMPLE = 20_000  # labelled rows the network may be fitted on, the first by a hash of their key
CHOOSERS = 16
GROUP_BYTES = 1 << 20
HIDDEN = 32
EPOCHS = 40

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1
_LOWER[128:] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def _forms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of each word's form: first and last byte's class, case, marks, length, repetition."""

    def inside(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data])])
        return total[ends] - total[starts]

    size = ends - starts
    upper, lower, digit = inside(_UPPER), inside(_LOWER), inside(_DIGIT)
    marks = size - upper - lower - digit
    last = data[ends - 1].astype(np.int64)
    last = np.where(_LOWER[last] > 0, 1, np.where(_UPPER[last] > 0, 2, np.where(_DIGIT[last] > 0, 3, last)))
    repeated = np.zeros(len(word), np.int64)
    repeated[1:] = word[1:] == word[:-1]
    form = last
    for part, most in ((_UPPER[data[starts]], 1), (upper, 3), (digit, 3), (marks, 4), (np.minimum(size, 24) // 4, 6), (repeated, 1), (lower, 1)):
        form = form * 8 + np.minimum(part, most)
    return spans.mix(form.astype(np.uint64) + np.uint64(1))


def _streams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(word hashes, form hashes, first word of each text, texts a..b) for groups of texts."""
    for a, b in spans.byte_groups(offsets, GROUP_BYTES):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = spans.words(part, offsets[a : b + 1] - offsets[a])
        word = spans.hashes(part, starts, ends)
        yield word, _forms(part, starts, ends, word), first, a, b


def _places(keys: np.ndarray, forms: bool) -> np.ndarray:
    """Words take the lower half of the places, forms the upper half."""
    half = 1 << (PLACE_BITS - 1)
    return (keys & np.uint64(half - 1)).astype(np.int64) + (half if forms else 0)


def _neighbour_sums(keys: np.ndarray, first: np.ndarray, forms: bool) -> np.ndarray:
    """Per place and dimension, the sum of the neighbours' index vectors."""
    place = _places(keys, forms) << DIM_BITS
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.zeros(1 << (PLACE_BITS + DIM_BITS), np.float64)
    for k in range(NONZERO):
        bits = keys >> np.uint64(16 + 8 * k)
        at = (bits & np.uint64(DIM - 1)).astype(np.int64)
        sign = (bits >> np.uint64(7) & np.uint64(1)).astype(np.float64) * 2 - 1
        index, weight = [], []
        for step in range(1, REACH + 1):
            if len(keys) > step:
                both = text[step:] == text[:-step]
                index += [(place[:-step] + at[step:])[both], (place[step:] + at[:-step])[both]]
                weight += [sign[step:][both], sign[:-step][both]]
        if index:
            total += np.bincount(np.concatenate(index), np.concatenate(weight), len(total))
    return total


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all places, unit length, summed over every text of `docs` (column text)."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << (PLACE_BITS + DIM_BITS), np.float64)
        for batch in batches:
            for word, form, first, _, _ in _streams(*spans.buffer(batch.column("text"))):
                total += _neighbour_sums(word, first, False)
                total += _neighbour_sums(form, first, True)
        if total.any():
            yield array_rows(total.astype("<i8"), PLACE_BITS + DIM_BITS, TaskContext.get().partitionId() % LANES)

    parts = docs.select("text").mapInArrow(learn, "shard int, lane int, counts binary")
    table = summed(parts, PLACE_BITS + DIM_BITS).reshape(-1, DIM).astype(np.float64)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(size, 1)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row of features per text; all zero without words."""
    out = np.zeros((len(offsets) - 1, 4 * DIM + 3), np.float32)
    for word, form, first, a, b in _streams(data, offsets):
        full = np.flatnonzero(np.diff(first))
        if not len(full):
            continue
        n = np.diff(first)[full].astype(np.float32)[:, None]
        columns = []
        for keys, forms in ((word, False), (form, True)):
            v = vectors[_places(keys, forms)]
            mean = np.add.reduceat(v, first[full]) / n
            spread = np.sqrt(np.maximum(np.add.reduceat(v * v, first[full]) / n - mean * mean, 0))
            columns += [mean, spread]
        new = [len(np.unique(word[first[k] : first[k + 1]])) for k in full]
        same = np.zeros(len(word))
        same[1:] = word[1:] == word[:-1]
        columns += [np.log(n), np.array(new, np.float32)[:, None] / n, np.add.reduceat(same, first[full])[:, None] / n]
        out[a + full] = np.concatenate(columns, axis=1)
    return out


class Network:
    """Two layers, tanh between, fitted with Adam; probabilities at a fitted temperature."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.prior = (labels.sum() + 1) / (len(labels) + 2)
        self.constant = len(labels) < 10 or labels.min() == labels.max()
        if self.constant:
            return
        order = rng.permutation(len(rows))
        held, fit = order[: max(1, len(rows) // 5)], order[max(1, len(rows) // 5) :]
        self.mean, self.scale = rows[fit].mean(axis=0), rows[fit].std(axis=0) + 1e-3
        x, y = self._standard(rows), labels.astype(np.float64)
        self.w = [
            rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            np.full(1, np.log(self.prior / (1 - self.prior))),
        ]
        self.temperature = 1.0
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self.w]
        step = 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                step += 1
                hidden = np.tanh(x[at] @ self.w[0] + self.w[1])
                error = (_sigmoid(hidden @ self.w[2] + self.w[3]) - y[at]) / len(at)
                back = np.outer(error, self.w[2]) * (1 - hidden * hidden)
                slopes = [x[at].T @ back + 1e-4 * self.w[0], back.sum(axis=0), hidden.T @ error + 1e-4 * self.w[2], error.sum(keepdims=True)]
                for p, g, m in zip(self.w, slopes, moments, strict=True):
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    p -= 3e-3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        logit = self._logit(x[held])
        tried = np.geomspace(0.5, 8, 41)
        loss = [np.mean(np.logaddexp(0, logit / t) - y[held] * logit / t) for t in tried]
        self.temperature = float(tried[int(np.argmin(loss))])

    def _standard(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -8, 8).astype(np.float64)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(rows), self.prior)
        return _sigmoid(self._logit(self._standard(rows)) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def learned_rows(texts: DataFrame, known: DataFrame, sample: int, features: Callable) -> list[Row]:
    """(key, quality, row) of at most `sample` labelled texts, the first by a hash; one per key and text, however often it is repeated."""
    marked = texts.join(F.broadcast(known), "key").withColumn("hash", F.xxhash64("key", "text"))
    chosen = marked.select("key", "hash").distinct().coalesce(CHOOSERS).orderBy("hash", "key").limit(sample)
    rows = marked.join(F.broadcast(chosen), ["key", "hash"]).select("key", "quality", "hash", "text")
    rows = rows.mapInArrow(features, "key string, quality int, hash long, row binary")
    return sorted(rows.groupBy("key", "quality", "hash").agg(F.first("row").alias("row")).drop("hash").collect())


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    cutoff: float = 0.3,
    sample: int = SAMPLE,
    key: str = "doc_id",
    text: str = "text",
    keep: bool = False,
) -> DataFrame:
    """(key, held_out, score, predicted): probability that a text is of label quality = 1.

    Word vectors are counts over every text; the network sees the labels of at most `sample` rows
    that are not held out, equal ones once, and nothing but texts. Null and empty texts have a score too, that of
    a text without words. A row without a key is scored and not held out; labels without key or
    value are ignored, a key labelled twice has its lowest label; with fewer than ten labels, or
    one kind only, every score is the labels' smoothed share. Other columns are dropped; `keep`
    adds the struct `row` of all of them. Runs jobs when called.
    """
    spark = docs.sparkSession
    tokens.arrow_batches(spark)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    vectors = spark.sparkContext.broadcast(word_vectors(texts))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pooled(*spans.buffer(batch.column("text")), vectors.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").cast(pa.string()),
                    batch.column("quality"),
                    batch.column("hash"),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                names=["key", "quality", "hash", "row"],
            )

    known = (
        labels.where(f"`{key}` is not null and quality is not null")
        .where(~held_out(F.col(key)))
        .groupBy(F.col(key).alias("key"))
        .agg(F.min("quality").cast("int").alias("quality"))
        .coalesce(CHOOSERS)  # each task sends its first `sample` rows
        .orderBy(F.xxhash64("key"), "key")
        .limit(sample)
    )
    fit = learned_rows(texts, known, sample, features)
    width = 4 * DIM + 3
    rows = np.frombuffer(b"".join(r["row"] for r in fit), np.float32).reshape(-1, width)
    network = Network(rows, np.array([r["quality"] for r in fit], np.int64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = network(pooled(*spans.buffer(batch.column("text")), vectors.value))
            out = batch.drop_columns(["text"])
            yield out.append_column("score", pa.array(p.astype(np.float64)))

    row = [F.struct("*").alias("row")] if keep else []
    held = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), *row, F.col(text).alias("text"))
    shape = T.StructType([*held.drop("text").schema.fields, T.StructField("score", T.DoubleType())])
    scored = held.mapInArrow(score, shape)
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int")).withColumnRenamed("key", key)
