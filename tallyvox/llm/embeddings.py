"""Embedding near duplicates by int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm import tokens
from tallyvox.llm.components import components
from tallyvox.session import materialize

TILE = 4096
MOST_PIVOTS = 1024
ROWS = 512  # rows of a tile product held at once
SLACK = 1e-5  # above the rounding of the scaled float32 products


def quantize(full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit rows, int8 rows, scale, error): |unit - scale * int8| <= error for every row."""
    unit = full / np.linalg.norm(full / np.abs(full).max(axis=1, keepdims=True), axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - small * scale[:, None], axis=1) + 1e-12
    return unit, small, scale, error


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 products, exact: float32 holds every partial sum of up to 1,040 of them."""
    out = np.zeros((len(a), len(b)), np.float32 if a.shape[1] <= 1040 else np.float64)
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine(x[i], y[j]) >= threshold, some rows of x at a time.

    A product of quantised vectors is off by at most error_x + (1 + error_x) * error_y. Pairs that
    stay below the threshold with that added are dropped, pairs above with it taken off are links,
    and only the rest is computed again in double precision.
    """
    ux, qx, sx, ex = quantize(x)
    uy, qy, sy, ey = (ux, qx, sx, ex) if same else quantize(y)
    for a in range(0, len(x), ROWS):
        b = slice(a, a + ROWS)
        near = product(qx[b], qy)
        near *= sy.astype(near.dtype)
        floor = (threshold - ex[b] - (1 + ex[b]) * ey.max() - SLACK) / sx[b]
        i, j = np.nonzero(near >= floor[:, None].astype(near.dtype))
        if same:
            i, j = i[i + a != j], j[i + a != j]
        value = near[i, j].astype(np.float64) * sx[a + i]
        bound = ex[a + i] + (1 + ex[a + i]) * ey[j] + SLACK
        link = value - bound >= threshold
        open_ = np.flatnonzero(~link & (value + bound >= threshold))
        for k in range(0, len(open_), 1 << 17):
            at = open_[k : k + (1 << 17)]
            p, q = x[a + i[at]], y[j[at]]
            cosine = np.einsum("ij,ij->i", p, q) / (np.sqrt(np.einsum("ij,ij->i", p, p)) * np.sqrt(np.einsum("ij,ij->i", q, q)))
            link[at] = cosine >= threshold
        yield a + i[link], j[link]


def _least_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels spread to the smallest over the links i-j."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            return label
        label = new


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Some vectors by a hash, unit length, by dimension; as many as there are tiles, 1,024 at most."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, max(1, -(-n // TILE)))).select("embedding").collect()
    by: dict[int, list] = {}
    for (v,) in rows:
        v = np.array(v, np.float64)
        v = v / np.abs(v).max()
        by.setdefault(len(v), []).append(v / np.linalg.norm(v))
    return {d: np.array(v) for d, v in by.items()}


def embedding_groups(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept): vectors linked by a cosine of the threshold or more.

    Equal vectors are one entry with a weight. Entries go to the cell of their nearest pivot and,
    within a cell, by a hash to tiles of about 4,096. Two cells meet only if their pivots' angle
    less both radii is within the threshold's angle; tiles of cells that meet are multiplied.
    A tile pair reports, per vector, the number of linked vectors and the smallest id connected
    inside the pair, so links never become rows.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing:
    n_links 0, own component, kept. Vectors of different length do not link. Rows of one key are
    one document whose other rows count as links if they are linked. A row without a key is kept,
    with a null component, and links with nothing. Other columns are dropped. Runs jobs when called.
    """
    spark = vectors.sparkSession
    tokens.arrow_batches(spark)
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = rows.where(F.col("key").isNotNull() & F.coalesce(finite, F.lit(False)))
    named = usable.groupBy("embedding").agg(F.min("key").alias("id"), F.count("*").alias("weight"))
    entries = materialize(named)
    n = entries.count()
    pivots = _pivots(entries, n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            cell, angle = np.zeros(len(dims), np.int64), np.full(len(dims), np.pi)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                cell[at] = int(d) << 16
                if int(d) in pivots:
                    unit = quantize(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64))[0]
                    near = unit @ pivots[int(d)].T
                    best = near.argmax(axis=1)
                    cell[at] += best
                    angle[at] = np.arccos(np.clip(near[np.arange(len(at)), best], -1, 1)) + 1e-7
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    kind = entries.schema["embedding"].dataType.simpleString()
    placed = materialize(
        entries.select("id", "weight", "embedding").mapInArrow(place, f"id long, weight long, embedding {kind}, cell long, angle double")
    )
    cells = {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    if not cells:
        found = rows.withColumn("n_links", F.lit(0).cast("long")).withColumn("component", F.lit(None).cast("long"))
        return _shaped(found, key)

    parts = spark.createDataFrame([(c, -(-k // TILE)) for c, (k, _) in cells.items()], "cell long, parts long")
    tiled = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def gather(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        values = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table(
            {
                "cell": table.column("cell").slice(0, 1),
                "part": table.column("part").slice(0, 1),
                "ids": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()),
                "weights": pa.array([table.column("weight").to_numpy().tobytes()], pa.binary()),
                "values": pa.array([values.tobytes()], pa.binary()),
                "wide": pa.array([values.dtype == np.float64]),
            }
        )

    shape = "cell long, part long, ids binary, weights binary, values binary, wide boolean"
    tiles = materialize(tiled.select("cell", "part", "id", "weight", "embedding").groupBy("cell", "part").applyInArrow(gather, shape))

    reach = np.arccos(threshold) + 1e-6
    meet = []
    for a, (_, ra) in cells.items():
        for b, (_, rb) in cells.items():
            if a <= b and a >> 16 == b >> 16:
                p = pivots.get(a >> 16)
                apart = 0.0 if p is None or a == b else float(np.arccos(np.clip(p[a & 0xFFFF] @ p[b & 0xFFFF], -1, 1)))
                if apart - ra - rb <= reach:
                    meet.append((a, b))
    meeting = spark.createDataFrame(meet, "xcell long, ycell long")

    def side(name: str) -> DataFrame:
        return tiles.select(*(F.col(c).alias(name + c) for c in tiles.columns))

    where = tiles.select("cell", "part")
    pairs = (
        meeting.join(where.select(F.col("cell").alias("xcell"), F.col("part").alias("xpart")), "xcell")
        .join(where.select(F.col("cell").alias("ycell"), F.col("part").alias("ypart")), "ycell")
        .where("xcell < ycell or xpart <= ypart")
    )
    met = pairs.join(side("x"), ["xcell", "xpart"]).join(side("y"), ["ycell", "ypart"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = (r["xcell"], r["xpart"]) == (r["ycell"], r["ypart"])
                kind = np.float64 if r["xwide"] else np.float32
                xi, yi = (np.frombuffer(r[c + "ids"], np.int64) for c in "xy")
                xw, yw = (np.frombuffer(r[c + "weights"], np.int64) for c in "xy")
                x, y = (np.frombuffer(r[c + "values"], kind).reshape(-1, r["xcell"] >> 16).astype(np.float64) for c in "xy")
                ids = xi if same else np.concatenate([xi, yi])
                shift = 0 if same else len(xi)
                label, count, touched = ids.copy(), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                for i, j in tile_links(x, y, threshold, same):
                    count[: len(xi)] += np.bincount(i, yw[j], len(xi)).astype(np.int64)
                    if not same:
                        count[shift:] += np.bincount(j, xw[i], len(yi)).astype(np.int64)
                    touched[i] = touched[shift + j] = True
                    back = np.searchsorted(np.sort(ids), label)
                    at = np.argsort(ids)[back]
                    hub, node = np.flatnonzero(touched), at[touched]
                    label = _least_labels(label, np.concatenate([i, hub]), np.concatenate([shift + j, node]))
                at = np.flatnonzero(touched)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(count[at]), pa.array(label[at])], names=["id", "links", "label"])

    columns = [c + v for c in "xy" for v in ("cell", "part", "ids", "weights", "values", "wide")]
    found = materialize(met.select(*columns).mapInArrow(compare, "id long, links long, label long"))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("label").alias("b"))).withColumnRenamed("node", "id")
    whole = (
        entries.join(linked, "id", "left")
        .join(groups, "id", "left")
        .select("embedding", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    return _shaped(usable.join(whole, "embedding").select("key", "n_links", "component").unionByName(
        rows.where(~(F.col("key").isNotNull() & F.coalesce(finite, F.lit(False)))).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    ), key)


def _shaped(found: DataFrame, key: str) -> DataFrame:
    own = F.coalesce("component", "key")
    return found.select(
        F.col("key").alias(key), "n_links", own.alias("component_id"), F.coalesce(F.col("key") == own, F.lit(True)).alias("kept")
    )
