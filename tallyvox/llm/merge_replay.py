"""Byte-level BPE by replaying merges over all distinct words of a batch at once."""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm import spans, tokens


class Merges:
    """The rank file: which two tokens make a token, and the bytes of each."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.byte = [rank[bytes([k])] for k in range(256)]
        self.pair = {
            (rank[whole[:k]], rank[whole[k:]]): made
            for whole, made in rank.items()
            for k in range(1, len(whole))
            if whole[:k] in rank and whole[k:] in rank
        }
        held = [b""] * (max(rank.values()) + 1)
        for whole, made in rank.items():
            held[made] = whole
        self.size = np.array([len(b) for b in held], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(held), np.uint8)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word.

        All words lie in one list of symbols, linked to their neighbours. An inverted index maps a
        rank to the positions where its pair stands; ranks are taken in ascending order, each one
        merges at all its positions from the left, and a merge only looks up the two pairs it
        newly makes. A new pair of a rank that is not higher goes first, so every word sees the
        order it would see alone.
        """
        byte, pair = self.byte, self.pair
        symbol: list[int] = []
        for w in words:
            symbol.extend([byte[b] for b in w])
            symbol.append(-1)
        n = len(symbol)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for at in range(n - 1):
            made = pair.get((symbol[at], symbol[at + 1]))
            if made is not None:
                index.setdefault(made, []).append(at)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for k, at in enumerate(places):
                right = after[at]
                if symbol[at] < 0 or pair.get((symbol[at], symbol[right])) != rank:
                    continue
                symbol[at], symbol[right] = rank, -2
                follow = after[right]
                after[at] = follow
                before[follow] = at
                lower = False
                left = before[at]
                for a, b in ((left, at), (at, follow)):
                    if a >= 0:
                        made = pair.get((symbol[a], symbol[b]))
                        if made is not None:
                            if made in index:
                                index[made].append(a)
                            else:
                                index[made] = [a]
                                heapq.heappush(heap, made)
                            lower |= made <= rank
                if lower:
                    index.setdefault(rank, []).extend(places[k + 1 :])
                    heapq.heappush(heap, rank)
                    break
        out, at = [], 0
        for w in words:
            row, stop = [], at + len(w)
            while at < stop:
                row.append(symbol[at])
                at = after[at]
            out.append(row)
            at = stop + 1
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids behind each other."""
        return self.bytes[spans.flat(self.start[ids], self.size[ids])]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> tokens.Encoder:
    """Encoder by a rank file; each match of the pattern is encoded separately."""
    import regex

    find = regex.compile(pattern).findall
    table = merges(path)

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = [find(u.decode()) for u in units]
        place: dict[str, int] = {}
        for parts in split:
            for w in parts:
                place.setdefault(w, len(place))
        coded = table.replay([w.encode() for w in place])
        rows = [[i for w in parts for i in coded[place[w]]] for parts in split]
        return np.array([i for r in rows for i in r], np.uint32), np.array([len(r) for r in rows], np.int64)

    return tokens.Encoder(encode)


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): whole texts encoded by the rank file, and decoded again.

    Nothing is shuffled. Null and empty texts have no token and the digests of no bytes; a null
    key and repeated rows are kept as they are; other columns are dropped.
    """
    tokens.arrow_batches(docs.sparkSession)

    def run(batches):
        encoder, table = rank_encoder(path, pattern), merges(path)
        for batch in batches:
            data, offsets = spans.buffer(batch.column("text"))
            rows = []
            for a, b in spans.byte_groups(offsets):
                ids, at = encoder(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                back = table.decode(ids).tobytes()
                raw, cut = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(table.size[ids])])[at]
                for k in range(b - a):
                    rows.append(
                        (
                            int(at[k + 1] - at[k]),
                            hashlib.sha256(raw[4 * at[k] : 4 * at[k + 1]]).hexdigest(),
                            hashlib.sha256(back[cut[k] : cut[k + 1]]).hexdigest(),
                        )
                    )
            n, coded, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
