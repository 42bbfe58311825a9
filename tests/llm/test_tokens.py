"""Token operators against the libraries, text by text."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallyvox.llm import wavelet
from tallyvox.llm.merge_replay import encode_decode, merges
from tallyvox.llm.packing import pack, pack_lengths
from tallyvox.llm.token_counts import token_counts


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def ranks(path):
    with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@pytest.mark.parametrize("table", ["odd", "small", "none"])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts(request, path, plain, table, name):
    docs = request.getfixturevalue(table)
    own = Tokenizer.from_file(path(name))
    want = Counter((k, len(t.encode()), len(own.encode(t, add_special_tokens=False).ids)) for k, t in plain(docs))
    rows = token_counts(docs, path(name)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)


def test_counts_of_pieces(odd, path, plain):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    rows = token_counts(odd, path("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((k, len(own.encode(t))) for k, t in plain(odd))


@pytest.mark.parametrize("table", ["odd", "small", "none"])
def test_merge_replay(request, path, plain, ranks, table):
    docs = request.getfixturevalue(table)
    want = Counter()
    for k, t in plain(docs):
        ids = ranks.encode_ordinary(t)
        want[k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    rows = encode_decode(docs, path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_replay_of_hard_words(path, ranks):
    words = ["a" * 60, "=" * 77, "abcabcabc" * 9, "\x00\x01é" * 7, "  " * 20, "aaaaaaab", "日本語" * 5]
    got = merges(path("byte_bpe_50k.tiktoken")).replay([w.encode() for w in words])
    assert got == [ranks._core_bpe.encode_single_piece(w.encode()) for w in words]


@pytest.mark.parametrize("table", ["odd", "small", "none"])
def test_packing(request, path, plain, table):
    docs = request.getfixturevalue(table)
    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = pack(docs, path("byte_bpe_50k.json"), 256).collect()
    want, got = Counter(), Counter()
    for k, t in plain(docs):
        want[k] += len(own.encode(t, add_special_tokens=False).ids) + 1
    at = {}
    for r in rows:
        got[r.doc_id] += r.length
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end <= 256
    assert len(at) * 256 - sum(want.values()) <= 256 * max(1, len(at) // 100)
    whole = {k: [*own.encode(t, add_special_tokens=False).ids, 1] for k, t in plain(docs)}
    once = Counter(k for k, _ in plain(docs))
    for r in rows:
        if once[r.doc_id] == 1:
            assert r.ids_crc32 == crc(whole[r.doc_id][r.start : r.start + r.length])
            assert r.doc_tokens == len(whole[r.doc_id])


def test_pieces_cover_each_document_once():
    lengths = np.random.default_rng(3).integers(1, 5000, 400)
    seen = [np.zeros(n, int) for n in lengths]
    for k, start, n, _, _ in pack_lengths(lengths, 2048):
        seen[k][start : start + n] += 1
    assert all((s == 1).all() for s in seen)


@pytest.mark.parametrize("table", ["odd", "small", "none"])
def test_shards(request, path, plain, table):
    docs = request.getfixturevalue(table)
    own = Tokenizer.from_file(path("word_bpe_49k.json"))
    rows = wavelet.write_and_read(docs, path("word_bpe_49k.json")).collect()
    start, want = 0, Counter()
    for k, t in sorted(plain(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = [*own.encode(t, add_special_tokens=False).ids, 1]
        want[k, start, len(ids), crc(ids)] += 1
        start += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 513, 9000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 40 if n > 600 else 49_408, n)
    m = wavelet.WaveletMatrix(wavelet.build(ids, 16))
    assert (m.ids() == ids).all()
    for i in rng.integers(0, max(n, 1), 8) if n else []:
        token = int(ids[i])
        where = np.flatnonzero(ids == token)
        assert m.access(int(i)) == token
        assert m.rank(token) == len(where) and m.rank(token, int(i)) == (where < i).sum()
        assert m.select(token, len(where) // 2) == where[len(where) // 2] and m.select(token, len(where)) == -1
    assert m.rank(50_000) == 0 and m.select(70_000, 0) == -1


def test_find_token(spark, small, path):
    folder = wavelet.shard_folder(spark)
    wavelet.write_shards(small, path("word_bpe_49k.json"), folder)
    found = wavelet.find_token(spark, folder, 1, most=3).collect()
    assert sum(r.n for r in found) >= small.count() and all(len(r.places) == min(3, r.n) for r in found)


def mirrored(n=2048):
    """A Thue-Morse text and its complement: a polynomial modulo a power of two cannot tell them apart."""
    text = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return [text, text.translate(str.maketrans("ab", "ba"))]


@pytest.mark.parametrize("same_hash", [False, True])
def test_units_of_equal_hash(path, ranks, monkeypatch, same_hash):
    from tallyvox.llm import merge_replay, spans, tokens

    if same_hash:
        monkeypatch.setattr(spans, "hashes", lambda data, starts, ends: np.ones(len(starts), np.uint64))
    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    encoder = tokens.library_encoder.__wrapped__(path("byte_bpe_50k.json"))
    replay = merge_replay.rank_encoder.__wrapped__(path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for texts in [mirrored(), ["one two"], mirrored()[1:], ["one owt", "", "two one"], ["one two"]]:
        data, at = spans.buffer(pa.array(texts, pa.string()))
        for run, want in ((encoder, lambda t: own.encode(t, add_special_tokens=False).ids), (replay, ranks.encode_ordinary)):
            ids, stops = run(data, at)
            assert [ids[a:b].tolist() for a, b in zip(stops[:-1], stops[1:], strict=True)] == [want(t) for t in texts]


def test_mirrored_words_differ(spark):
    from tallyvox.llm.minhash import near_duplicates

    rows = [(k, " ".join([t + s for s in "xyzuvw"])) for k, t in enumerate(mirrored())]
    assert [r.kept for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()] == [True, True]


def test_equal_spans():
    from tallyvox.llm import spans

    texts = [b"", b"a", b"b", b"abcdefgh", b"abcdefgx", b"abcdefghi", b"abcdefghj", b"abcdefghijklmnopq", b"abcdefghijklmnopx", b"zz"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    found = spans.equal(data, at[:-1][a], at[1:][a], data, at[:-1][b], at[1:][b])
    assert found.tolist() == [texts[i] == texts[j] for i, j in zip(a, b, strict=True)]


def test_short_spans_are_compared_at_once(monkeypatch):
    from tallyvox.llm import spans

    long = []
    inner = spans._chunks
    monkeypatch.setattr(spans, "_chunks", lambda data, starts, size: long.append(len(starts)) or inner(data, starts, size))
    data = np.frombuffer(b" the cat sat on the extraordinarily" * 9, np.uint8)
    starts = np.flatnonzero(data == 32)
    ends = np.append(starts[1:], len(data))
    assert spans.equal(data, starts, ends, data, starts, ends).all()
    assert sum(long) == 2 * 9  # the only ones over eight bytes, in either buffer


def test_planes_are_packed_from_bits(monkeypatch):
    kinds, inner = [], np.packbits
    monkeypatch.setattr(np, "packbits", lambda a, *more: kinds.append(a.dtype) or inner(a, *more))
    ids = np.random.default_rng(4).integers(0, 1 << 16, 5000).astype(np.uint32)
    file = wavelet.build(ids, 16)
    monkeypatch.undo()
    assert kinds == [np.dtype(bool)] * 16  # wider ones are packed thirty times slower
    assert (wavelet.WaveletMatrix(file).ids() == ids).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_without_offsets(path, name):
    from tallyvox.llm import tokens

    units = [f" w{k} é{k}".encode() for k in range(40_000)] + [b"", b"a <|endoftext|> b", b"x" * 5000, " 日本".encode()]
    ids, counts = tokens.library_encoder(path(name)).encode(units)
    own = Tokenizer.from_file(path(name))
    some = [*range(0, len(units), 997), *range(len(units) - 4, len(units)), 511, 512, 16_383, 16_384]
    begin = np.cumsum(counts) - counts
    for k in some:
        assert ids[begin[k] : begin[k] + counts[k]].tolist() == own.encode(units[k].decode(), add_special_tokens=False).ids
