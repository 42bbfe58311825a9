"""Exact top-k search of many questions over a whole chunk table.

Questions are cut into blocks of bounded rows and bytes. A block goes to every task, chunks are
scanned where they are and never copied (those of a few files are dealt over the cores once), and a
task keeps the k best per question, so pairs never become rows. There is one way for all sizes: a
small question table is one block.

Vectors are pruned exactly: a task cuts its chunks into cells around pivots. No vector of a cell is
nearer to a question than its pivot's angle less the cell's radius allows, so a cell that cannot
reach a question's k-th score so far is skipped. The rest are multiplied in single precision first;
only pairs that may reach the k-th score, by the bound of its rounding, are scored in double precision.

Trigrams are made inside the tasks, from the words of a text, and never leave them: three code points are
one number, and the sorted numbers of a block of texts give the sets of all of them at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyvox.functions.text import word_text
from tallyvox.operators.dashboard import ranked
from tallyvox.session import checkpoint_dir, materialize

# Scores are rounded so that ranks do not depend on how rows were cut into batches.
SCORE_DIGITS = 9
QUESTION_BLOCK = 16_384
QUESTION_BYTES = 64 << 20
CHUNK_BLOCK = 2_048
PAIRS_AT_ONCE = 1 << 22
SLACK = 1e-7  # what rounding may take from a bound
TILE = 1 << 19  # pairs whose products stay in a core's cache
HITS_AT_ONCE = 1 << 17
CODE_BITS = 21  # of a code point
DENSE_QUESTIONS, DENSE_CHUNKS = 1 << 24, 1 << 22  # entries of a table of questions or chunks by trigrams
POSTINGS_COST = 200  # of one step along a posting list, in multiplications of a matrix product
UNPRUNED = 7  # blocks of chunks taken whole after one where cells left little to skip

# Weights and thresholds of the lexical arm.
TITLE_WEIGHT = 3.0
SECTION_WEIGHT = 2.0
VERSION_WEIGHT = 2.5
BODY_WEIGHT = 1.0
FIELD_THRESHOLD = 0.12
BODY_THRESHOLD = 0.15


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(length of every list, all their values behind each other); a null list is empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, column.flatten().to_numpy(zero_copy_only=False)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_pandas().to_numpy()


def _best_first(rows: np.ndarray, ids: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Order by row, score down, id. Rounded scores are whole numbers, so one number holds row and score."""
    whole = np.rint(found * 10.0**SCORE_DIGITS).astype(np.int64)
    gap = whole.max(initial=0) - whole
    bits = int(gap.max(initial=0)).bit_length()
    if len(rows) == 0 or bits + int(rows.max()).bit_length() > 62:
        return np.lexsort((ids, -found, rows))
    key = (rows.astype(np.int64) << bits) | gap
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    if len(tied):
        some = order[tied]
        order[tied] = some[np.lexsort((ids[some], key[tied]))]
    return order


class Best:
    """The k best chunks of every question so far; ties at the edge are settled by chunk id."""

    def __init__(self, questions: int, k: int):
        self.k, self.floor = k, np.full(questions, -np.inf)
        self.parts: list[tuple] = []
        self.pending, self.limit = 0, max(2 * questions * k, 1 << 16)
        self.pairs = self.computed = self.whole = 0

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of the questions `rows` with the chunks `ids`; minus infinity is no hit."""
        self.computed += scores.size
        floor = self.floor[rows]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        r, c = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        self.take(rows[r], ids[c], scores[r, c])

    def take(self, rows: np.ndarray, ids: np.ndarray, found: np.ndarray) -> None:
        """Pairs that may be among the best."""
        if len(rows):
            self.parts.append((rows, ids, found))
            self.pending += len(rows)
        if self.pending > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.parts:
            return None
        rows, ids, found = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = _best_first(rows, ids, found)
        rows, ids, found = rows[order], ids[order], found[order]
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        place = np.arange(len(rows)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(rows)]])))
        last = place == self.k - 1
        self.floor[rows[last]] = found[last]
        best = place < self.k
        self.parts, self.pending = [(rows[best], ids[best], found[best])], int(best.sum())
        return self.parts[0]


class CosineKernel:
    """Similarity of `embedding` columns."""

    columns = ("embedding",)

    @staticmethod
    def entries(column: str) -> Column:
        return F.size(column)

    def __init__(self, exclude_same_id: bool = False):
        self.exclude_same_id = exclude_same_id

    def prepare(self, questions: pa.Table) -> tuple:
        return _ids(questions.column("query_id")), self._unit(questions.column("embedding").combine_chunks())

    @staticmethod
    def _unit(vectors: pa.Array) -> np.ndarray:
        flat = _lists(vectors)[1].astype(np.float64)
        matrix = flat.reshape(len(vectors), len(flat) // max(1, len(vectors)))
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.where(norms == 0, 1.0, norms)

    def _offer(self, best: Best, prepared: tuple, rows: np.ndarray, ids: np.ndarray, unit: np.ndarray, but: tuple | None = None) -> None:
        asked, questions = prepared
        step = max(1, TILE // max(1, len(unit)))
        small = unit.astype(np.float32)
        error = (unit.shape[1] + 4) * 2.0**-23 + 10.0**-SCORE_DIGITS
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            edge = best.floor[some]
            if np.isfinite(edge).all():
                near = questions[some].astype(np.float32) @ small.T >= (edge - error).astype(np.float32)[:, None]
                if np.count_nonzero(near) * 4 <= near.size:
                    best.computed += near.size
                    self._settle(best, prepared, some, ids, unit, np.flatnonzero(near), but)
                    continue
            scores = np.round(questions[some] @ unit.T, SCORE_DIGITS)
            if self.exclude_same_id:
                scores[asked[some][:, None] == ids[None, :]] = -np.inf
            if but is not None:
                own, cell = but
                scores[own[some][:, None] == cell[None, :]] = -np.inf
            best.offer(some, ids, scores)

    def _settle(self, best: Best, prepared: tuple, some: np.ndarray, ids: np.ndarray, unit: np.ndarray, hits: np.ndarray, but: tuple | None) -> None:
        """Exact scores of the pairs `hits` (places in the table of `some` by `ids`)."""
        asked, questions = prepared
        for a in range(0, len(hits), HITS_AT_ONCE):
            r, c = np.divmod(hits[a : a + HITS_AT_ONCE], len(ids))
            r = some[r]
            keep = np.ones(len(r), bool)
            if self.exclude_same_id:
                keep &= asked[r] != ids[c]
            if but is not None:
                keep &= but[0][r] != but[1][c]
            r, c = r[keep], c[keep]
            scores = np.round(np.einsum("ij,ij->i", questions[r], unit[c]), SCORE_DIGITS)
            keep = scores >= best.floor[r]
            best.take(r[keep], ids[c[keep]], scores[keep])

    def scan(self, prepared: tuple, ids: np.ndarray, chunks: pa.RecordBatch, best: Best) -> None:
        """Offers every chunk that may be among the k best of a question."""
        unit, questions = self._unit(chunks.column("embedding")), prepared[1]
        everyone = np.arange(len(questions))
        best.pairs += len(everyone) * len(unit)
        cells = int(np.sqrt(len(unit)))
        there = (np.abs(unit).sum(axis=1) > 0) if len(unit) else np.zeros(0, bool)
        begun = bool(np.isfinite(best.floor).all())
        if cells < 8 or not there.all() or not len(everyone) or (begun and best.whole):
            best.whole = max(0, best.whole - 1)
            self._offer(best, prepared, everyone, ids, unit)
            if not begun:
                best.cut()
            return None
        pivots = unit[:: len(unit) // cells][:cells]
        near = unit @ pivots.T
        cell = near.argmax(axis=1)
        order = np.argsort(cell, kind="stable")
        unit, ids, cell = unit[order], ids[order], cell[order]
        edges = np.searchsorted(cell, np.arange(cells + 1))
        least = np.full(cells, 1.0)
        np.minimum.at(least, cell, near[order, cell])
        to_pivot = np.clip(questions @ pivots.T, -1, 1)
        own = to_pivot.argmax(axis=1) if not begun else np.full(len(questions), -1)
        if not begun:
            for c in range(cells):
                rows = np.flatnonzero(own == c)
                if len(rows):
                    self._offer(best, prepared, rows, ids[edges[c] : edges[c + 1]], unit[edges[c] : edges[c + 1]])
            best.cut()
        bound = np.cos(np.maximum(np.arccos(to_pivot) - np.arccos(np.clip(least, -1, 1)), 0)) + SLACK
        bound[np.abs(questions).sum(axis=1) == 0] = 1.0  # nothing has an angle to these; all scores are 0
        wanted = (bound >= best.floor[:, None]) & (own[:, None] != np.arange(cells))
        if (wanted @ np.diff(edges)).sum() * 2 > len(everyone) * len(unit):
            best.whole = UNPRUNED
            self._offer(best, prepared, everyone, ids, unit, None if begun else (own, cell))  # little to skip: one product
        else:
            for c in range(cells):
                rows = np.flatnonzero(wanted[:, c])
                if len(rows):
                    self._offer(best, prepared, rows, ids[edges[c] : edges[c + 1]], unit[edges[c] : edges[c + 1]])
        if not begun:
            best.cut()


def trigram_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct three-letter pieces of each text, by row and code.

    `texts` holds words between blanks. A word is padded with two blanks left and one right; with three blanks
    between words a piece belongs to a word if its second or its third place is no blank.
    """
    padded = [f"  {(t or '').replace(' ', '   ')} " for t in texts.to_pylist()]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in padded], dtype=np.int64)])
    bits = int(points.max(initial=1)).bit_length()
    mask, step = (1 << bits) - 1, 1 << max(0, 62 - 3 * bits)
    rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(padded), step):
        b = min(len(padded), a + step)
        some = points[first[a] : first[b]]
        key = (some[:-2] << (2 * bits)) | (some[1:-1] << bits) | some[2:]
        key |= np.repeat(np.arange(b - a) << (3 * bits if b - a > 1 else 0), np.diff(first[a : b + 1]))[:-2]
        key = key[(some[1:-1] != 32) | (some[2:] != 32)]
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        rows.append(a + (key >> (3 * bits)))
        codes.append((((key >> (2 * bits)) & mask) << (2 * CODE_BITS)) | (((key >> bits) & mask) << CODE_BITS) | (key & mask))
    return np.concatenate(rows), np.concatenate(codes)


class _Sets:
    """Sets of trigrams, as (row, place in the vocabulary) entries of those it knows."""

    def __init__(self, texts: pa.Array, vocabulary: np.ndarray):
        rows, flat = trigram_sets(texts)
        self.sizes = np.bincount(rows, minlength=len(texts))
        place = np.searchsorted(vocabulary, flat)
        known = np.flatnonzero(vocabulary[np.minimum(place, len(vocabulary) - 1)] == flat) if len(vocabulary) else np.zeros(0, np.int64)
        self.rows, self.places = rows[known], place[known]


class _Index(_Sets):
    """Posting lists of the questions: rows by trigram."""

    def __init__(self, texts: pa.Array, vocabulary: np.ndarray):
        super().__init__(texts, vocabulary)
        self.vocabulary, self.own, self.table = len(vocabulary), self.places, None
        self.own_rows = self.rows
        self.rows = self.rows[np.argsort(self.places, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.places, minlength=len(vocabulary)))])

    def shared(self, other: _Sets) -> np.ndarray:
        """Common trigrams of every question with every set, by a matrix product or along the posting lists."""
        width = len(other.sizes)
        size = len(self.sizes) * self.vocabulary
        count = self.first[other.places + 1] - self.first[other.places]
        if size <= DENSE_QUESTIONS and count.sum() * POSTINGS_COST > size * width:
            return self._product(other)
        out = np.zeros(len(self.sizes) * width, dtype=np.int64)
        stops = np.concatenate([[0], np.cumsum(count)])
        start = 0
        while start < len(count):
            stop = max(start + 1, int(np.searchsorted(stops, stops[start] + PAIRS_AT_ONCE, side="right")) - 1)
            n = count[start:stop]
            at = np.repeat(self.first[other.places[start:stop]] - (stops[start:stop] - stops[start]), n)
            rows = self.rows[at + np.arange(int(n.sum()))]
            out += np.bincount(rows * width + np.repeat(other.rows[start:stop], n), minlength=len(out))
            start = stop
        return out.reshape(len(self.sizes), width).astype(np.float64)

    def _product(self, other: _Sets) -> np.ndarray:
        """Counts below 2^24 are exact in single precision."""
        if self.table is None:
            self.table = np.zeros((len(self.sizes), self.vocabulary), np.float32)
            self.table[self.own_rows, self.own] = 1
        out = np.zeros((len(self.sizes), len(other.sizes)))
        step = max(1, DENSE_CHUNKS // max(1, self.vocabulary))
        for a in range(0, len(other.sizes), step):
            some = slice(*np.searchsorted(other.rows, [a, a + step]))
            chunks = np.zeros((min(step, len(other.sizes) - a), self.vocabulary), np.float32)
            chunks[other.rows[some] - a, other.places[some]] = 1
            out[:, a : a + step] = self.table @ chunks.T
        return out


class TrigramKernel:
    """Weighted trigram similarity over the words of title, section, version and body."""

    columns = ("q_words", "e_words")

    @staticmethod
    def entries(column: str) -> Column:
        return F.length(column) + 1  # a word has one piece more than letters

    def prepare(self, questions: pa.Table) -> tuple:
        plain, expanded = (questions.column(c).combine_chunks() for c in self.columns)
        vocabulary = np.unique(np.concatenate([trigram_sets(c)[1] for c in (plain, expanded)]))
        return _ids(questions.column("query_id")), vocabulary, _Index(plain, vocabulary), _Index(expanded, vocabulary)

    @staticmethod
    def _similarity(questions: _Index, field: _Sets) -> np.ndarray:
        shared = questions.shared(field)
        total = questions.sizes[:, None] + field.sizes[None, :] - shared
        return np.divide(shared, total, out=np.zeros_like(shared), where=total > 0)

    def scan(self, prepared: tuple, ids: np.ndarray, chunks: pa.RecordBatch, best: Best) -> None:
        everyone = np.arange(len(prepared[0]))
        step = max(1, PAIRS_AT_ONCE // 4 // max(1, len(everyone)))
        best.pairs += len(everyone) * len(ids)
        for a in range(0, len(ids), step):
            best.offer(everyone, ids[a : a + step], self.score(prepared, chunks.slice(a, step)))

    def score(self, prepared: tuple, chunks: pa.RecordBatch) -> np.ndarray:
        _, vocabulary, plain, expanded = prepared
        fields = {
            name: _Sets(chunks.column(f"{name}_words"), vocabulary)
            for name in ("title", "section", "tag", "number", "body")
        }
        title = self._similarity(plain, fields["title"])
        section = self._similarity(plain, fields["section"])
        body = self._similarity(plain, fields["body"])
        version = np.maximum.reduce(
            [self._similarity(q, fields[f]) for q in (plain, expanded) for f in ("tag", "number")]
        )
        scores = (
            TITLE_WEIGHT * title + SECTION_WEIGHT * section + VERSION_WEIGHT * version + BODY_WEIGHT * body
        )
        matched = (
            (body >= BODY_THRESHOLD)
            | (title >= FIELD_THRESHOLD)
            | (section >= FIELD_THRESHOLD)
            | (version >= FIELD_THRESHOLD)
        )
        return np.where(matched, np.round(scores, SCORE_DIGITS), -np.inf)


def _spread(chunks: DataFrame) -> DataFrame:
    """Chunks of fewer files than there are cores are dealt over these, each once; others are scanned where they are."""
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    return chunks if len(chunks.inputFiles()) >= cores else chunks.repartition(cores, "chunk_id")


def top_k(
    questions: DataFrame,
    chunks: DataFrame,
    kernel: CosineKernel | TrigramKernel,
    k: int,
    question_block: int = QUESTION_BLOCK,
    chunk_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best chunks per question, ties by chunk id.

    Counts the questions when called and brings them to the driver block by block, at most
    `question_block` rows and QUESTION_BYTES each, from where a block is broadcast. One block's result
    is lazy; of several, each is written to the shared folder before the next is sent.
    """
    spark = chunks.sparkSession
    types = {"query_id": questions.schema["query_id"].dataType, "chunk_id": chunks.schema["chunk_id"].dataType}
    names = [t.simpleString() for t in types.values()]
    size = questions.agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.greatest(kernel.entries(c), F.lit(0))).alias(c) for c in kernel.columns)
    ).first()
    blocks = max(1, -(-size["n"] // question_block), -(-8 * sum(size[c] or 0 for c in kernel.columns) // QUESTION_BYTES))
    if blocks > 1:  # every block reads both
        questions, chunks = materialize(questions), materialize(chunks)
    arrow = [to_arrow_type(t) for t in types.values()]

    def partial(block: int) -> tuple[DataFrame, object]:
        some = questions.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else questions
        shared = spark.sparkContext.broadcast(kernel.prepare(some.toArrow()))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            prepared = shared.value
            best = Best(len(prepared[0]), k)
            for batch in batches:
                for a in range(0, batch.num_rows, chunk_block):
                    some = batch.slice(a, chunk_block)
                    kernel.scan(prepared, _ids(some.column("chunk_id")), some, best)
            found = best.cut()
            if found is not None:
                rows, ids, scores = found
                columns = [pa.array(prepared[0][rows], arrow[0]), pa.array(ids, arrow[1]), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])

        rows = chunks.mapInArrow(scan, f"query_id {names[0]}, chunk_id {names[1]}, score double")
        return ranked(rows, k, [F.desc("score"), "chunk_id"], "query_id"), shared

    if blocks == 1:
        return partial(0)[0]
    folder = f"{checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"
    for block in range(blocks):
        rows, shared = partial(block)
        rows.write.mode("append").parquet(folder)
        shared.unpersist()
    return spark.read.parquet(folder)


def vector_arm(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = 40,
    exclude_same_id: bool = False,
    question_block: int = QUESTION_BLOCK,
    chunk_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """`questions(query_id, embedding)` against `chunks(chunk_id, embedding)` by cosine; rows without a vector have no hits."""
    return top_k(
        questions.select("query_id", "embedding").where("embedding is not null"),
        _spread(chunks.select("chunk_id", "embedding").where("embedding is not null")),
        CosineKernel(exclude_same_id),
        k,
        question_block,
        chunk_block,
    )


def lexical_arm(
    questions: DataFrame, chunks: DataFrame, k: int = 40, question_block: int = QUESTION_BLOCK, chunk_block: int = CHUNK_BLOCK
) -> DataFrame:
    """`questions(query_id, text, expanded)` against chunk title, section, version and body."""
    asked = questions.select(
        "query_id",
        word_text(F.col("text")).alias("q_words"),
        word_text(F.col("expanded")).alias("e_words"),
    )
    number = F.col("version_no").cast("string")
    indexed = _spread(chunks).select(
        "chunk_id",
        word_text(F.col("title")).alias("title_words"),
        word_text(F.col("section_heading")).alias("section_words"),
        word_text(F.concat(F.lit("v"), number)).alias("tag_words"),
        word_text(number).alias("number_words"),
        word_text(F.coalesce("lexical_text", "content")).alias("body_words"),
    )
    return top_k(asked, indexed, TrigramKernel(), k, question_block, chunk_block)
