"""Token shards as wavelet matrices: bit planes with rank directories, in compressed files.

A shard row holds the ids of consecutive documents. Plane p holds bit p (from the top) of every
id, ordered by the bits above it; one count of ones per 512 bits gives rank in constant time and
select by bisection. Each plane is compressed in chunks of its own, so reading one token,
counting a token or finding its k-th place opens 2 to 3 chunks per plane and nothing else.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.llm import tokens
from tallyvox.operators.ordering import running_before
from tallyvox.session import checkpoint_dir

MAGIC = b"WVM1"
CHUNK = 1 << 15  # bytes of a plane compressed together
BLOCK = 64  # bytes of a plane per entry of the rank directory
SHARD_IDS = 1 << 22
_ONES = np.array([bin(k).count("1") for k in range(256)], np.uint8)


def build(ids: np.ndarray, bits: int) -> bytes:
    """The file of the ids: header, per plane its zeros, directory and chunks."""
    level = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    parts = [MAGIC, struct.pack("<IQ", bits, len(level))]
    for p in range(bits - 1, -1, -1):
        ones = (level & level.dtype.type(1 << p)).astype(bool)
        plane = np.packbits(ones)
        counts = np.add.reduceat(_ONES[plane].astype(np.uint32), np.arange(0, len(plane), BLOCK)) if len(plane) else np.zeros(0, np.uint32)
        rank = zlib.compress((np.cumsum(counts) - counts).astype("<u4").tobytes(), 1)
        raw = plane.tobytes()
        chunks = [zlib.compress(raw[a : a + CHUNK], 1) for a in range(0, len(raw), CHUNK)]
        zeros = level[~ones]
        parts.append(struct.pack("<QII", len(zeros), len(rank), len(chunks)))
        parts.append(np.array([len(c) for c in chunks], "<u4").tobytes())
        parts += [rank, *chunks]
        if p:
            level = np.concatenate([zeros, level[ones]])
    return b"".join(parts)


class WaveletMatrix:
    """Queries on one file; chunks are opened when they are needed."""

    def __init__(self, file: bytes):
        if file[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.file = file
        self.bits, self.n = struct.unpack_from("<IQ", file, 4)
        at, self.planes = 16, []
        for _ in range(self.bits):
            zeros, rank_size, count = struct.unpack_from("<QII", file, at)
            at += 16
            sizes = np.frombuffer(file, "<u4", count, at).astype(np.int64)
            at += 4 * count
            begin = at + rank_size + np.concatenate([[0], np.cumsum(sizes)])
            self.planes.append((zeros, at, rank_size, begin))
            at = int(begin[-1])
        self._rank = lru_cache(maxsize=self.bits)(self._read_rank)
        self._chunk = lru_cache(maxsize=4 * self.bits)(self._read_chunk)

    def _read_rank(self, p: int) -> np.ndarray:
        _, at, size, _ = self.planes[p]
        return np.frombuffer(zlib.decompress(self.file[at : at + size]), "<u4")

    def _read_chunk(self, p: int, k: int) -> np.ndarray:
        begin = self.planes[p][3]
        return np.frombuffer(zlib.decompress(self.file[begin[k] : begin[k + 1]]), np.uint8)

    def _bit(self, p: int, i: int) -> int:
        byte = self._chunk(p, (i >> 3) // CHUNK)[(i >> 3) % CHUNK]
        return (int(byte) >> (7 - (i & 7))) & 1

    def _rank1(self, p: int, i: int) -> int:
        """Ones among the first i bits of plane p."""
        if i >= self.n:
            return self.n - self.planes[p][0]
        byte = i >> 3
        block = byte // BLOCK
        part = self._chunk(p, byte // CHUNK)[block * BLOCK % CHUNK : byte % CHUNK + 1]
        inside = int(_ONES[part[:-1]].sum()) + int(_ONES[int(part[-1]) & (0xFF00 >> (i & 7)) & 0xFF])
        return int(self._rank(p)[block]) + inside

    def _place(self, p: int, k: int, one: bool) -> int:
        """Index of the k-th (from 0) one or zero of plane p, by bisection on rank."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(p, mid + 1)
            if (ones if one else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for p in range(self.bits):
            bit, ones = self._bit(p, i), self._rank1(p, i)
            value = value << 1 | bit
            i = self.planes[p][0] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for p in range(self.bits):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            if token >> (self.bits - 1 - p) & 1:
                lo, hi = self.planes[p][0] + a, self.planes[p][0] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int | None = None) -> int:
        """How often the token stands among the first i ids (all by default)."""
        if token >> self.bits or not self.n:
            return 0
        lo, hi = self._range(token, self.n if i is None else i)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the token, -1 if there are fewer."""
        if token >> self.bits or not self.n:
            return -1
        lo, hi = self._range(token, self.n)
        if k >= hi - lo:
            return -1
        i = lo + k
        for p in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - p) & 1
            i = self._place(p, i - self.planes[p][0] if one else i, bool(one))
        return i

    def ids(self) -> np.ndarray:
        """All ids: the planes' partitions undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        level = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            zeros, _, _, begin = self.planes[p]
            chunks = [self._read_chunk(p, k) for k in range(len(begin) - 1)]
            plane = np.concatenate(chunks) if chunks else np.zeros(0, np.uint8)
            ones = np.unpackbits(plane, count=self.n).view(bool)
            above = np.empty(self.n, kind)
            above[~ones] = level[:zeros]
            above[ones] = level[zeros:] | kind(1 << (self.bits - 1 - p))
            level = above
        return level.astype(np.uint32)


def write_shards(docs: DataFrame, path: str, folder: str, bits: int = 16, key: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, append the end id to each, and write shard files in ascending key order.

    Texts are range-partitioned by key once. A task writes a row per about four million ids, so a
    shard's memory is bounded however large the partition is. Files are ordinary Parquet with one
    binary column, committed by Spark's writer, so a lost executor leaves no half-written shard.
    Null and empty texts are the end id alone; a null key comes first; rows of equal key are
    ordered by text.
    """
    tokens.arrow_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        tokens.library_encoder(path).limit = 3 << 19
        keys: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            ids, size = np.concatenate(held), np.concatenate(sizes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()),
                    pa.array([number], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(keys[0].type)),
                    pa.array([size.tolist()], pa.list_(pa.int64())),
                    pa.array([build(ids, bits)], pa.binary()),
                ],
                names=["part", "number", "n_ids", "keys", "sizes", "matrix"],
            )

        for batch, _, ids, at in tokens.encoded(batches, path):
            ids, at = tokens.with_end(ids, at)
            keys.append(batch.column("key"))
            sizes.append(np.diff(at))
            held.append(ids)
            if sum(map(len, held)) >= SHARD_IDS:
                yield shard()
                number += 1
                keys, sizes, held = [], [], []
        if held and sum(map(len, held)):
            yield shard()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    (
        rows.repartitionByRange("key")
        .sortWithinPartitions("key", "text")
        .mapInArrow(encode, f"part long, number long, n_ids long, keys array<{kind}>, sizes array<long>, matrix binary")
        .write.option("compression", "none")
        .parquet(folder)
    )


def shard_documents(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, decoded from the shard files."""
    tokens.arrow_batches(spark)
    shards = spark.read.parquet(folder)
    begin = running_before(shards.select("part", "number", "n_ids"), [], ["part", "number"], F.col("n_ids"), "before")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size = np.array(batch.column("sizes")[k].as_py(), np.int64)
                ids = WaveletMatrix(batch.column("matrix")[k].as_py()).ids()
                at = np.concatenate([[0], np.cumsum(size)])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                n = len(size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("keys")[k].values,
                        pa.array(np.full(n, batch.column("part")[k].as_py())),
                        pa.array(np.full(n, batch.column("number")[k].as_py())),
                        pa.array(at[:-1]),
                        pa.array(size),
                        pa.array(crc, pa.int64()),
                    ],
                    names=[key, "part", "number", "inside", "n_tokens", "ids_crc32"],
                )

    kind = shards.schema["keys"].dataType.elementType.simpleString()
    decoded = shards.select("part", "number", "keys", "sizes", "matrix").mapInArrow(
        decode, f"`{key}` {kind}, part long, number long, inside long, n_tokens long, ids_crc32 long"
    )
    return decoded.join(begin.select("part", "number", "before"), ["part", "number"]).select(
        f"`{key}`", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def find_token(spark: SparkSession, folder: str, token: int, most: int | None = None) -> DataFrame:
    """(part, number, n, places): occurrences of a token in each shard, by rank and select alone.

    `most` bounds the places listed per shard, for a report of the first ones; n counts all.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                matrix = WaveletMatrix(batch.column("matrix")[k].as_py())
                n = matrix.rank(token)
                places = [matrix.select(token, i) for i in range(n if most is None else min(n, most))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("part").slice(k, 1),
                        batch.column("number").slice(k, 1),
                        pa.array([n], pa.int64()),
                        pa.array([places], pa.list_(pa.int64())),
                    ],
                    names=["part", "number", "n", "places"],
                )

    return (
        spark.read.parquet(folder)
        .select("part", "number", "matrix")
        .mapInArrow(find, "part long, number long, n long, places array<long>")
    )


def shard_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names."""
    return f"{checkpoint_dir(spark)}/token-shards-{uuid.uuid4().hex}"


def write_and_read(docs: DataFrame, path: str, bits: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of the documents written to a new shared folder, and their documents read back."""
    folder = shard_folder(docs.sparkSession)
    write_shards(docs, path, folder, bits, key, text)
    return shard_documents(docs.sparkSession, folder, key)
