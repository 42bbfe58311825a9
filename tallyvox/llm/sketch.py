"""Counts of hashed values in a table of fixed size, summed over all rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SHARD_BITS = 16
LANES = 16  # tasks' arrays are added in so many groups first


def bucket_counts(df: DataFrame, column: str, bits: int, values_of: Callable | None = None) -> np.ndarray:
    """How many values fall into each of 2^bits buckets (low bits of the value).

    `column` is a long, or `values_of` makes 64-bit values of a batch. Each task counts into one
    array and reports it in compressed shards; the shards are added up in Spark, in two steps so
    that no sum sees one row per task. The driver gets 2^bits counts whatever the input's size.
    Null adds nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            raw = values_of(batch) if values_of else batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            total += np.bincount((raw & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        if total.any():
            yield array_rows(total, bits, TaskContext.get().partitionId() % LANES)

    return summed(df.select(column).mapInArrow(count, "shard int, lane int, counts binary"), bits)


def array_rows(total: np.ndarray, bits: int, lane: int) -> pa.RecordBatch:
    width = 1 << min(bits, SHARD_BITS)
    n = (1 << bits) // width
    shards = [zlib.compress(total[k * width : (k + 1) * width].tobytes(), 1) for k in range(n)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int32()), pa.array([lane] * n, pa.int32()), pa.array(shards, pa.binary())],
        names=["shard", "lane", "counts"],
    )


def summed(parts: DataFrame, bits: int, signed: np.dtype = np.dtype("<i8")) -> np.ndarray:
    """Sum of one array of 2^bits numbers per task, from rows made by `array_rows`."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(v.as_py()), signed) for v in table.column("counts"))
        return pa.table(
            {
                "shard": table.column("shard").slice(0, 1),
                "lane": table.column("lane").slice(0, 1),
                "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()),
            }
        )

    shape = "shard int, lane int, counts binary"
    whole = parts.groupBy("shard", "lane").applyInArrow(add, shape).groupBy("shard").applyInArrow(add, shape)
    out = np.zeros(1 << bits, signed)
    width = 1 << min(bits, SHARD_BITS)
    for row in whole.select("shard", "counts").collect():
        out[row["shard"] * width : (row["shard"] + 1) * width] = np.frombuffer(zlib.decompress(row["counts"]), signed)
    return out
