"""Cost-balanced packing of documents into fixed-length training sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm import spans, tokens

BLOCK_BYTES = 4 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024  # attention over 1024 tokens costs as much as everything else


def cost(length):
    """Estimated cost of a piece: linear for the layers, quadratic for attention inside it."""
    return LINEAR * length + QUADRATIC * length * length


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of the given documents.

    Whole multiples of the capacity fill sequences of their own. What remains of each document is
    taken in descending order and goes, whole, to the sequence of lowest cost that has room for
    it. Where none has, it is cut over the roomiest ones. All sequences but the slack of less
    than one are full.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    number = 0
    for k in np.flatnonzero(lengths >= capacity):
        for start in range(0, int(lengths[k]) // capacity * capacity, capacity):
            pieces.append((int(k), start, capacity, number, 0))
            number += 1
    rest = lengths % capacity
    open_count = -(-int(rest.sum()) // capacity)
    spent = np.zeros(open_count)
    room = np.full(open_count, capacity, np.int64)
    for k in np.argsort(-rest, kind="stable"):
        left, start = int(rest[k]), int(lengths[k] - rest[k])
        while left:
            fits = np.flatnonzero(room >= left)
            at = int(fits[np.argmin(spent[fits])]) if len(fits) else int(np.argmax(room))
            size = min(left, int(room[at]))
            pieces.append((int(k), start, size, number + at, capacity - int(room[at])))
            room[at] -= size
            spent[at] += cost(size)
            left, start = left - size, start + size
    return pieces


def dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """`rows` (key, text) with their block, by a hash of key and length; rows that repeat both beyond a share of a block are dealt over more."""
    sized = rows.withColumn("size", F.octet_length("text"))
    often = (
        sized.groupBy("key", "size")
        .agg(F.count("*").alias("n"))
        .withColumn("parts", F.ceil(F.col("n") * (F.col("size") + 16) / F.lit(BLOCK_BYTES // 8)))
        .where("n > 1 and parts > 1")
        .select(F.col("key").alias("_key"), F.col("size").alias("_size"), "parts")
    )
    met = sized.join(F.broadcast(often), F.col("key").eqNullSafe(F.col("_key")) & (F.col("size") == F.col("_size")), "left")
    salt = F.when(F.col("parts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("parts")))
    return met.select("key", "text", F.pmod(F.xxhash64("key", "size", salt), F.lit(blocks)).alias("block"))


def pack(docs: DataFrame, path: str, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids by the file's library and id 1. Documents are dealt by a hash into
    blocks of about 4 MB of text, each packed on its own, so padding is below one sequence per
    block and the only shuffle of texts moves each once; many rows of one key and length go to several blocks. Null and empty texts are the end id alone;
    a null key and repeated rows are packed like any other; an empty table gives no piece;
    other columns are dropped.
    """
    spark = docs.sparkSession
    tokens.arrow_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(16)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))

    def pack_block(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("key", "ascending"), ("text", "ascending")])
        data, offsets = spans.buffer(table.column("text"))
        ids, at = tokens.with_end(*tokens.library_encoder(path)(data, offsets))
        pieces = pack_lengths(np.diff(at), capacity)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        begin = at[doc] + start
        crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(begin, length, strict=True)]
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                key: table.column("key").take(pa.array(doc)),
                "start": start,
                "length": length,
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": np.diff(at)[doc],
                "sequence_id": sequence + (block << 32),
                "offset": offset,
            }
        )

    return dealt(rows, blocks).groupBy("block").applyInArrow(
        pack_block,
        f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
