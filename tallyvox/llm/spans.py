"""Cutting whole batches of texts into spans, and 64-bit hashes of the spans.

A batch is the byte buffer of an Arrow string column: all texts behind each other and their
offsets. Everything here works on that buffer at once, without a Python object per word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

WINDOW = 1 << 21  # bytes hashed at once; bounds the memory of a step
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# A cut in front of a space is safe unless one of these follows it: white space and control bytes,
# first bytes of multi-byte white space (c2, e1, e2, e3), and "<", which may open a special token.
_UNSAFE_NEXT = np.zeros(256, bool)
_UNSAFE_NEXT[:33] = True
_UNSAFE_NEXT[[0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ",.!#&*$%;:?"]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the maximal runs without ASCII white space; text k owns the runs
    first[k] .. first[k + 1]."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of pieces that a byte-pair tokenizer with a word pattern encodes
    independently of each other.

    Cuts: in front of a single space that a word follows, and between an ASCII letter and a
    sentence mark. No pattern of the supported tokenizers matches across either.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        cut[: n - 1] |= (data[:-1] == 32) & ~_UNSAFE_NEXT[data[1:]]
        cut[1:n] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    cut[offsets] = True
    cut[n] = False
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, offsets)


def _chunks(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eight bytes as a number, its place in the span, chunks before each span) of all spans; the last chunk is cut with zeros."""
    count = (size + 7) >> 3
    stops = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(stops[-1]) - np.repeat(stops[:-1], count)
    at = np.repeat(starts, count) + (place << 3)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, 0, (1,))
    left = np.minimum(np.repeat(size, count) - (place << 3), 8)
    return wide[at] & _MASK[left], place, stops


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span; equal bytes have equal hashes wherever they stand.

    Every eight bytes are mixed with their place before they are added up, so that repetitive and
    mirrored texts do not cancel out. Whoever needs certainty compares with `equal`.
    """
    out = np.empty(len(starts), np.uint64)
    size = np.maximum(ends - starts, 0)
    k = 0
    while k < len(starts):
        if size[k] > WINDOW:
            digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
            out[k] = int.from_bytes(digest, "little")
            k += 1
            continue
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + WINDOW, side="right")))
        part = data[starts[k] : ends[stop - 1]]
        value, place, stops = _chunks(part, starts[k:stop] - starts[k], size[k:stop])
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ mix((place.astype(np.uint64) + np.uint64(1)) * _ODD)))])
        out[k:stop] = mix(total[stops[1:]] - total[stops[:-1]] + size[k:stop].astype(np.uint64) * _ODD)
        k = stop
    return out


def _first(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to the first eight bytes of every span as a number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, 0, (1,))[starts] & _MASK[np.minimum(size, 8)]


def equal(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray
) -> np.ndarray:
    """Whether every span has the same bytes as its partner in the other buffer."""
    size = np.maximum(ends - starts, 0)
    same = size == np.maximum(other_ends - other_starts, 0)
    at = np.flatnonzero(same & (size > 0))
    same[at] = _first(data, starts[at], size[at]) == _first(other, other_starts[at], size[at])
    at = at[same[at] & (size[at] > 8)]
    a = 0
    while a < len(at):
        b = a + max(1, int(np.searchsorted(np.cumsum(size[at[a : a + WINDOW // 8]]), WINDOW, side="right")))
        some = at[a:b]
        mine, _, stops = _chunks(data, starts[some], size[some])
        theirs, _, _ = _chunks(other, other_starts[some], size[some])
        same[some] = np.add.reduceat(mine != theirs, stops[:-1]) == 0
        a = b
    return same


def flat(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions first[k], first[k] + 1, ... (count[k] of them) for every k, behind each other."""
    count = count.astype(np.int64)
    before = np.cumsum(count) - count
    return np.repeat(first.astype(np.int64) - before, count) + np.arange(int(count.sum()))


def byte_groups(offsets: np.ndarray, limit: int = WINDOW) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` bytes; a longer text stands alone."""
    groups, k, n = [], 0, len(offsets) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + limit, side="right")) - 1)
        groups.append((k, min(stop, n)))
        k = stop
    return groups
