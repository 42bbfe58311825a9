"""Records of CSV files that several tasks read, although cells may hold line breaks.

A file is cut into splits of lines. Whether a line ends inside a quoted cell depends on how it
starts, so a split is a function of two states. Pass one computes it per split and composes the
functions in file order; what comes out is one small row per split. Pass two glues the lines of a
split to records from its known start. Lines before a split's first record, and its unfinished last
record, are fragments, at most two per split, which are joined across splits. Texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "start"]


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open behind the line. Quotes open a cell only at its beginning; doubled ones are text;
    a cell with anything behind its closing quote goes on unquoted to the next comma."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            inside = False
        else:
            begin = at
            while line[begin : begin + 1] in (" ", "\t"):
                begin += 1
            if line[begin : begin + 1] == '"':
                inside, at = True, begin + 1
                continue
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"),
        F.col("_metadata.file_size").alias("size"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """(split, its lines) for the splits that follow each other in a batch."""
    file, start = (batch.column(c) for c in range(2))
    n = batch.num_rows
    if not n:
        return
    same = pc.and_(pc.equal(file.slice(1), file.slice(0, n - 1)), pc.equal(start.slice(1), start.slice(0, n - 1)))
    cuts = [0, *(np.flatnonzero(~np.asarray(same.to_numpy(zero_copy_only=False), bool)) + 1).tolist(), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield (file[a].as_py(), start[a].as_py()), batch.column(2).slice(a, b - a)


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, size of the file, from_outside, from_inside): the state behind a split for either state before it."""
    found: dict[tuple[str, int], tuple[bool, bool]] = {}
    sizes: dict[tuple[str, int], int] = {}
    for batch in batches:
        at = 0
        for split, lines in _runs(batch):
            sizes[split] = batch.column(3)[at].as_py()
            at += len(lines)
            outside, inside = found.get(split, (False, True))
            # Lines without a quote change nothing.
            for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
                together = outside == inside
                outside = ends_inside(line, outside)
                inside = outside if together else ends_inside(line, inside)
            found[split] = outside, inside
    rows = [(*k, sizes[k], *v) for k, v in found.items()]
    if rows:
        names = [*SPLIT, "size", "from_outside", "from_inside"]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def split_starts(lines: DataFrame) -> DataFrame:
    """(file, start, size, inside): whether a split begins inside a cell, by composing the splits before it."""
    functions = lines.mapInArrow(
        _functions, "file string, start long, size long, from_outside boolean, from_inside boolean"
    )
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # A split ends alike for both starts, or keeps the state, or swaps it.
    swap = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    known = functions.withColumn("swaps", F.coalesce(F.sum(swap).over(earlier), F.lit(0))).withColumn(
        "fixed",
        F.when(F.col("from_outside") == F.col("from_inside"), (F.col("from_outside").cast("int") + F.col("swaps")) % 2),
    )
    last = F.coalesce(F.last("fixed", ignorenulls=True).over(earlier), F.lit(0))
    return known.select(*SPLIT, "size", ((last + F.col("swaps")) % 2 == 1).alias("inside"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, head, record): every record as one text; `head` marks the first of a file.

    Positions are unique and grow with the files' names and in each file: the bytes before a
    record's split, and its number in the split less one. Blank records are left out, as CSV readers
    do; a carriage return at the end of a line is no part of it. Runs a job when called, from which
    the driver keeps the list of files, as the scan itself does, and of splits that begin in a cell.
    """
    lines = _lines(spark, path)
    begun = F.collect_list(F.when(F.col("inside"), F.col("start")))
    files = split_starts(lines).groupBy("file").agg(F.max("size").alias("size"), begun.alias("begun")).collect()
    known, before = {}, 0
    for r in sorted(files, key=lambda r: r.file):
        known[r.file] = before, frozenset(r.begun)
        before += r.size
    shared = spark.sparkContext.broadcast(known)

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        glued = _Glue(shared.value)
        for batch in batches:
            for split, lines in _runs(batch):
                glued.add(split, lines)
            yield from glued.take()
        glued.end_split()
        yield from glued.take()

    found = lines.mapInArrow(glue, "file string, position long, head boolean, kind long, record string")
    order = Window.partitionBy("file").orderBy("position")
    joined = (
        found.where(F.col("kind") != WHOLE)
        .withColumn("group", F.sum((F.col("kind") == BEGUN).cast("int")).over(order))
        .groupBy("file", "group")
        .agg(F.sort_array(F.collect_list(F.struct("position", "head", "record"))).alias("parts"))
        .select(
            "file",
            F.col("parts")[0]["position"].alias("position"),
            F.col("parts")[0]["head"].alias("head"),
            F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"),
        )
    )
    return found.where(F.col("kind") == WHOLE).drop("kind").unionByName(joined)


WHOLE, BEGUN, GOES_ON, ENDED = range(4)  # a record; its first, middle and last lines where splits cut it


class _Glue:
    """Glues the lines of the splits that a task reads."""

    def __init__(self, known: dict[str, tuple[int, frozenset]]):
        self.known, self.split, self.out = known, None, []

    def add(self, split: tuple[str, int], lines: pa.Array) -> None:
        if split != self.split:
            self.end_split()
            self.split, self.no, self.held = split, 0, []
            self.before, begun = self.known[split[0]]
            self.inside = self.headless = split[1] in begun
        quoted = pc.match_substring(lines, '"').to_pylist()
        for line, has in zip(lines.to_pylist(), quoted, strict=True):
            self.held.append(line.removesuffix("\r"))
            if has:
                self.inside = ends_inside(line, self.inside)
            if not self.inside:
                self._flush(ENDED if self.headless else WHOLE)

    def _flush(self, kind: int) -> None:
        record = "\n".join(self.held)
        if kind != WHOLE or record.strip(" \t\r"):
            file, start = self.split
            self.out.append((file, self.before + start + self.no - 1, start == 0 and self.no == 0, kind, record))
            self.no += 1
        self.held, self.headless = [], False

    def end_split(self) -> None:
        if self.split is not None and self.held:
            self._flush(GOES_ON if self.headless else BEGUN)

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            names = ["file", "position", "head", "kind", "record"]
            rows, self.out = self.out, []
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
