"""Token ids of whole texts by public tokenizer files, a batch at a time.

The library encodes each distinct unit (see `spans.units`) once; a text's ids are its units' ids
behind each other. Units are separate inputs of the library, split by a special token, so nothing
depends on what they stood next to.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from tallyvox.llm import spans

END = 1  # id appended to each document where a contract asks for it
BATCH_BYTES = 8 << 20


def arrow_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds by bytes, so that long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


class Encoder:
    """Ids of units by one `encode` function, with a bounded memory of short units."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 1 << 19):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.text = np.zeros(0, np.uint8)  # the units themselves, so that equal hashes are not taken for equal units
        self.begin = np.zeros(0, np.int64)
        self.end = np.zeros(0, np.int64)

    def _known(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the memory, whether the unit is there, whether its hash is there)."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), *(np.zeros(len(keys), bool) for _ in range(2))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        held = self.keys[at] == keys
        known = held.copy()
        some = np.flatnonzero(held)
        known[some] = spans.equal(data, starts[some], ends[some], self.text, self.begin[at[some]], self.end[at[some]])
        return at, known, held

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text in ids)."""
        out, counts = [], []
        for a, b in spans.byte_groups(offsets):
            ids, n = self._group(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out.append(ids)
            counts.append(n)
        ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))]).astype(np.int64)

    def _group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = spans.units(data, offsets)
        keys, example, code = np.unique(spans.hashes(data, starts, ends), return_index=True, return_inverse=True)
        s, e = starts[example], ends[example]
        if not spans.equal(data, starts, ends, data, s[code], e[code]).all():
            return self._unhashed(data, starts, ends, first)
        if len(self.keys) > self.limit:
            self._clear()
        at, known, held = self._known(keys, data, s, e)
        new = np.flatnonzero(~known)
        start = np.where(known, self.start[at] if len(self.keys) else 0, 0)
        size = np.where(known, self.size[at] if len(self.keys) else 0, 0)
        ids = self.ids
        if len(new):
            raw = data.tobytes()
            fresh, count = self.encode([raw[a:b] for a, b in zip(s[new], e[new], strict=True)])
            start[new], size[new] = len(ids) + np.cumsum(count) - count, count
            ids = np.concatenate([ids, fresh])
            self._keep(new[(count <= 16) & ~held[new]], keys, ids, start, size, data, s, e)
        per_unit = size[code]
        total = np.concatenate([[0], np.cumsum(per_unit)])
        return ids[spans.flat(start[code], per_unit)], np.diff(total[first])

    def _keep(self, short, keys, ids, start, size, data, s, e) -> None:
        """Remember the short ones of this group's new units."""
        place = np.searchsorted(self.keys, keys[short])
        held = len(self.ids) + np.cumsum(size[short]) - size[short]
        length = e[short] - s[short]
        begin = len(self.text) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, ids[spans.flat(start[short], size[short])]])
        self.text = np.concatenate([self.text, data[spans.flat(s[short], length)]])
        for name, values in (("keys", keys[short]), ("start", held), ("size", size[short]), ("begin", begin), ("end", begin + length)):
            setattr(self, name, np.insert(getattr(self, name), place, values))

    def _unhashed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for a group in which two units share a hash: units are told apart by their bytes."""
        raw, place = data.tobytes(), {}
        code = np.array([place.setdefault(raw[a:b], len(place)) for a, b in zip(starts, ends, strict=True)], np.int64)
        ids, size = self.encode(list(place))
        start, total = np.cumsum(size) - size, np.concatenate([[0], np.cumsum(size[code])])
        return ids[spans.flat(start[code], size[code])], np.diff(total[first])


@lru_cache(maxsize=2)
def library_encoder(path: str) -> Encoder:
    """Encoder of a tokenizers (.json) or sentencepiece (.model) file."""
    if path.endswith(".model"):
        return _pieces(path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    special = {t.content: k for k, t in own.get_added_tokens_decoder().items()}
    if not special or own.normalizer is None:  # without a normalizer, a call for each unit costs less than to find the special token
        return Encoder(lambda units: _one_by_one(own, units))
    mark, mark_id = next(iter(special.items()))

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [u.decode() for u in units]
        apart = [k for k, t in enumerate(texts) if "<" in t or len(t) > 4096]
        if apart:
            alone = dict(zip(apart, own.encode_batch_fast([texts[k] for k in apart], add_special_tokens=False), strict=True))
            texts = ["" if "<" in t or len(t) > 4096 else t for t in texts]
        parts, counts = [], np.zeros(len(texts), np.int64)
        for a in range(0, len(texts), 1 << 14):
            joined = [mark.join(texts[b : b + 512]) for b in range(a, min(a + (1 << 14), len(texts)), 512)]
            for b, found in zip(range(a, len(texts), 512), own.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(found.ids, np.uint32)
                stops = np.append(np.flatnonzero(ids == mark_id), len(ids))
                counts[b : b + len(stops)] = np.diff(np.concatenate([[-1], stops])) - 1
                parts.append(np.delete(ids, stops[:-1]))
        found = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if not apart:
            return found, counts
        rows = np.split(found, np.cumsum(counts)[:-1])
        for k, e in alone.items():
            rows[k] = np.array(e.ids, np.uint32)
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    return Encoder(encode)


def _one_by_one(own, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ids: list[int] = []
    counts: list[int] = []
    for a in range(0, len(units), 1 << 14):
        for found in own.encode_batch_fast([u.decode() for u in units[a : a + (1 << 14)]], add_special_tokens=False):
            some = found.ids
            ids += some
            counts.append(len(some))
    return np.array(ids, np.uint32), np.array(counts, np.int64)


def _pieces(path: str) -> Encoder:
    """A sentencepiece model normalizes across words, so whole texts are its units."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)

    class Whole(Encoder):
        def _group(self, data, offsets):
            raw = data.tobytes()
            rows = own.encode([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], num_threads=1)
            return np.array([i for r in rows for i in r], np.uint32), np.array([len(r) for r in rows], np.int64)

    return Whole(None)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The same with `end` behind each text."""
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))


def encoded(batches: Iterator[pa.RecordBatch], path: str, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, text offsets, ids, id offsets) for every batch."""
    encoder = library_encoder(path)
    for batch in batches:
        data, offsets = spans.buffer(batch.column(column))
        ids, at = encoder(data, offsets)
        yield batch, offsets, ids, at
