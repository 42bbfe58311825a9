"""Whitening of embeddings by the covariance of their distinct rounded vectors.

Vectors that round to the same integers are one weighted entry. Sums are exact, products are taken
of centred vectors, and every distinct vector is whitened once; rows get theirs back by a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.hot import attach
from tallyvox.llm.tokens import arrow_batches
from tallyvox.session import checkpoint_dir

SCALE = 256
_SAFE = 1 << 62


def rounded(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x) of the rows whose vector is there and finite; x = floor(SCALE * entry)."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    return vectors.where(v.isNotNull() & finite).select(
        F.col(key).alias("key"), F.transform(v, lambda c: F.floor(c * SCALE).cast("long")).alias("x")
    )


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, vectors as rows) for every length of vector in the batch."""
    x = batch.column("x")
    size = np.diff(x.offsets.to_numpy())
    values = x.values.to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        begin = x.offsets.to_numpy()[at]
        yield int(d), at, values[begin[:, None] + np.arange(d)].reshape(len(at), int(d))


def _exact_sum(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted column sums as Python integers."""
    bound = int(np.abs(x).max(initial=0).astype(object)) * int(w.sum())
    if 0 <= bound < _SAFE and (x != np.iinfo(np.int64).min).all():
        return (x * w[:, None]).sum(axis=0).astype(object)
    return (x.astype(object) * w.astype(object)[:, None]).sum(axis=0)


def _gap(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums exactly: 64-bit integers where their squares' sum fits, else Python integers."""
    most = max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))), default=0) * n
    most += max((abs(s) for s in sums), default=0)
    if most * most * max(1, x.shape[1]) < _SAFE:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _table(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _fit_sums(distinct: DataFrame, weight: str) -> dict[int, tuple[int, np.ndarray]]:
    """length -> (sum of weights, weighted sums per dimension), exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            w = batch.column(weight).to_numpy()
            for d, at, x in _matrices(batch):
                count[d] = count.get(d, 0) + int(w[at].sum())
                total[d] = total.get(d, 0) + _exact_sum(x, w[at])
        rows = [(d, i, str(s)) for d in count for i, s in enumerate([count[d], *total[d]], -1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["d", "i", "s"])

    sums = distinct.select("x", weight).mapInArrow(partial, "d long, i long, s string")
    found: dict[int, dict[int, int]] = {}
    for r in sums.groupBy("d", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        found.setdefault(r.d, {})[r.i] = int(r.s)
    return {d: (s[-1], np.array([s[i] for i in range(d)], object)) for d, s in found.items()}


def _covariances(distinct: DataFrame, weight: str, fit: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """length -> weighted covariance of centred vectors, divisor the sum of weights.

    Each task multiplies its own vectors; the rows of its products are added up per matrix row, so
    only the matrix itself reaches the driver.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            w = batch.column(weight).to_numpy()
            for d, at, x in _matrices(batch):
                n, sums = fit[d]
                centred = (_gap(x, n, sums) / n).astype(np.float64)
                total[d] = total.get(d, 0.0) + centred.T @ (centred * w[at][:, None])
        yield from _rows(total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, i, v in zip(*(batch.column(k) for k in range(3)), strict=True):
                place = d.as_py(), i.as_py()
                total[place] = total.get(place, 0.0) + v.values.to_numpy()
        for (d, i), v in total.items():
            yield _row(d, i, v)

    schema = "d long, i long, v array<double>"
    parts = distinct.select("x", weight).mapInArrow(products, schema)
    matrix = {d: np.zeros((d, d)) for d in fit}
    for r in parts.repartition("d", "i").mapInArrow(added, schema).collect():
        matrix[r.d][r.i] = r.v
    return {d: (m + m.T) / (2 * fit[d][0]) for d, m in matrix.items()}


def _row(d: int, i: int, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([d]), pa.array([i]), pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.float64()))],
        names=["d", "i", "v"],
    )


def _rows(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for d, m in total.items():
        for i in range(d):
            yield _row(d, i, m[i])


def _projections(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns that whiten, explained shares) of the leading components; a column without variance is NaN."""
    e, u = np.linalg.eigh(v)
    e, u = np.maximum(e[::-1][:components], 0.0), u[:, ::-1][:, :components]
    trace = float(np.trace(v))
    if u.size:
        u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    flat = e <= trace * len(v) * np.finfo(float).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(flat, np.nan, u / np.sqrt(e)), e / trace if trace else np.full(len(e), np.nan)


def _error(whitened: DataFrame, weight: str, d: int, k: int, live: list[int]) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    own = whitened.where(F.col("d") == d)
    w, c = F.col(weight), [F.col("whitened")[i] for i in range(k)]
    first = own.agg(F.sum(w).alias("n"), *(F.sum(w * c[i]).alias(f"s{i}") for i in live)).first()
    if not live:
        return None
    mean = {i: first[f"s{i}"] / first["n"] for i in live}
    pairs = [(i, j) for i in live for j in live if i <= j]
    second = own.agg(*(F.sum(w * (c[i] - mean[i]) * (c[j] - mean[j])).alias(f"p{i}_{j}") for i, j in pairs)).first()
    return max(abs(second[f"p{i}_{j}"] / first["n"] - (i == j)) for i, j in pairs)


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, weights: str = "one"
) -> DataFrame:
    """Whitened coordinates of every row on the leading principal components.

    Entries are rounded to x = floor(256 * entry). The fit takes each distinct x once (`weights`
    "one") or as often as it occurs ("counts"); n is its total weight, S the weighted sums. Returns
    per row and component, numbered from 1: (key, component, n, deviation, whitened, explained,
    identity_error). `deviation`, the exact sum of (n * x - S)^2, is a string of digits, as it may
    outgrow any number type. Runs jobs when called.

    Rows whose vector is null or holds null or non-finite entries are left out. Vectors of each
    length have a fit of their own; a square matrix per length is all that the driver holds. A
    component without variance has null coordinates and does not count in `identity_error`, which
    is null where no component has any. Null and repeated keys are rows like others, an empty vector
    has no components, an empty table gives no rows; other columns are ignored. An eigenvector's
    largest entry is positive.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    folder = f"{checkpoint_dir(spark)}/whitening-{uuid.uuid4().hex}"
    rows = rounded(vectors, key, vector)
    counted = rows.groupBy("x").agg(F.count("*").alias("copies"))
    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("long")
    distinct = _table(counted.withColumn("weight", weight), f"{folder}/distinct")
    fit = _fit_sums(distinct, "weight")
    made = {d: _projections(v, components) for d, v in _covariances(distinct, "weight", fit).items()}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _matrices(batch):
                n, sums = fit[d]
                gap = _gap(x, n, sums)
                found = (gap / n).astype(np.float64) @ np.nan_to_num(made[d][0])
                found[:, np.isnan(made[d][0]).any(axis=0)] = np.nan
                flat, m = found.reshape(-1), len(at)
                picked = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        picked.column("x"), picked.column("copies"), picked.column("weight"), pa.array(np.full(m, d)),
                        pa.array([str(s) for s in (gap * gap).sum(axis=1)]) if d else pa.array(["0"] * m),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(m + 1) * found.shape[1], pa.int32()), pa.array(flat, mask=np.isnan(flat))
                        ),
                    ],
                    names=["x", "copies", "weight", "d", "deviation", "whitened"],
                )

    schema = "x array<long>, copies long, weight long, d long, deviation string, whitened array<double>"
    whitened = _table(distinct.mapInArrow(project, schema), f"{folder}/whitened")
    facts = []
    for d, (w, explained) in made.items():
        live = [i for i in range(w.shape[1]) if not np.isnan(w[:, i]).any()]
        shares = [None if np.isnan(s) else float(s) for s in explained]
        facts.append((d, fit[d][0], shares, _error(whitened, "weight", d, w.shape[1], live)))
    per_length = spark.createDataFrame(facts, "d long, n long, explained array<double>, identity_error double")
    joined = attach(rows, whitened.select("x", "copies", "d", "deviation", "whitened"), "x", "copies")
    listed = joined.join(F.broadcast(per_length), "d").select(
        F.col("key").alias(key), "n", "deviation", "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"),
    )
    return listed.select(
        f"`{key}`", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error",
    )
