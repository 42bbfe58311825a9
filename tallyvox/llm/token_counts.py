"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm import tokens


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit): tokens of each whole text as the library of the file counts them.

    Nothing is shuffled. A task encodes groups of texts of about equal bytes; a longer text is a
    group of its own, and every text is split at boundaries no token crosses. Null and empty
    texts have 0 bytes and 0 tokens; a null key and repeated rows are kept as they are; other
    columns are dropped.
    """
    tokens.arrow_batches(docs.sparkSession)

    def count(batches):
        for batch, offsets, _, at in tokens.encoded(batches, path, "text"):
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
