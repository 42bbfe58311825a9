"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

Turns become letters; the corpus's letter sequences share one Re-Pair grammar, and each rule's
min-plus matrix gives the cheapest edits over everything it stands for.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.llm import grammar as gr
from tallyvox.llm.hot import attach
from tallyvox.llm.tokens import arrow_batches
from tallyvox.session import checkpoint_dir

KEY = ["conv_id", "turn", "role", "text"]
STATS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
WHITE = " \t\n\v\f\r"
MARKS = ".!?"
LEGAL = {"su", "ua", "au"}
SEGMENT = 1024  # letters of a conversation that are evaluated as one
PER_ROUND = 64  # rules a round of counting adds, the most frequent pairs first
MOST_RULES = 2048  # pairs beyond stay two symbols; results do not depend on it


def named(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    return df.select(*(F.col(a).alias(b) for a, b in zip([conversation, turn, role, text], KEY, strict=True)))


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with a fault each by crc32 of `conv_id:turn`, modulo 20, and `copies`: how often a turn stands there (0: dropped)."""
    kind = F.crc32(F.concat(_shown("conv_id"), F.lit(":"), _shown("turn"))) % 20
    text, role = _shown("text"), _shown("role")
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, MARKS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _letters(turns: DataFrame) -> DataFrame:
    """Equal turns as one row: (conv_id, turn, role, digest, initial, fault, copies, first).

    `first`: no equal role and text stands earlier in the conversation.
    """
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    there = F.col("copies") > 0
    fault = F.when(end == "", "blank").when(~F.lit(MARKS).contains(end), "truncated").otherwise("")
    equal = (
        turns.select(
            "conv_id",
            "turn",
            F.when(there, F.col("role")).alias("role"),
            F.when(there, _digest(F.col("text"))).alias("digest"),
            F.when(there, fault).alias("fault"),
            "copies",
        )
        .groupBy("conv_id", "turn", "role", "digest")
        .agg(F.first("fault").alias("fault"), F.sum("copies").alias("copies"))
    )
    earlier = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    return equal.withColumn("first", F.row_number().over(earlier) == 1)


class _Walk:
    """Letters and counts of one conversation, its turns given in order."""

    def __init__(self):
        self.letters: list[str] = []
        self.turns = [None, None, 0]
        self.count = Counter()
        self.before: str | None = None

    def add(self, turn, role: str, fault: str, first: bool, copies: int) -> None:
        initial = role[:1]
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        if self.before is not None:
            self.count["illegal"] += self.before + initial not in LEGAL
        self.count["illegal"] += copies - 1
        self.before = initial
        letter = initial if initial and initial in "sua" else "x"
        if fault == "blank":
            self.count["blank"] += copies
            self.letters += "D" * copies
            return
        fresh = 1 if first else 0
        self.count["duplicate"] += copies - fresh
        self.count["truncated"] += fresh * (fault == "truncated")
        self.letters += (letter.upper() if fault else letter) * fresh + "D" * (copies - fresh)

    def stats(self) -> dict:
        low, high, distinct = self.turns
        return {**{k: self.count[k] for k in STATS[1:]}, "gaps": 0 if low is None else high - low + 1 - distinct}


def _sequences(letters: DataFrame) -> DataFrame:
    """(conv_id, no, letters, counts) per SEGMENT letters of a conversation; the counts stand in its last row.

    A conversation streams through a task in order; a byte per turn of one segment is held.
    """
    ident = letters.schema["conv_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        own, no, state, any_row = None, 0, _Walk(), False

        def cut(final: bool) -> None:
            nonlocal no
            while len(state.letters) > SEGMENT or final:
                part, state.letters = state.letters[:SEGMENT], state.letters[SEGMENT:]
                last = final and not state.letters
                out.append({"conv_id": own, "no": no, "letters": "".join(part), **(state.stats() if last else {})})
                no += 1
                if last:
                    break

        for batch in batches:
            for r in batch.to_pylist():
                if not any_row or r["conv_id"] != own:
                    if any_row:
                        cut(True)
                    own, no, state, any_row = r["conv_id"], 0, _Walk(), True
                if r["copies"]:
                    state.add(r["turn"], r["role"], r["fault"], r["first"], r["copies"])
                    cut(False)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if any_row:
            cut(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    ordered = letters.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "digest"
    )
    id_type = pa_type(letters, "conv_id")
    schema = pa.schema(
        [("conv_id", id_type), ("no", pa.int64()), ("letters", pa.string()), *((c, pa.int64()) for c in STATS)]
    )
    return ordered.select("conv_id", "turn", "role", "fault", "first", "copies").mapInArrow(
        walk, f"conv_id {ident}, no long, letters string, " + ", ".join(f"{c} long" for c in STATS)
    )


def pa_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _rules(distinct: DataFrame) -> list[tuple[int, int]]:
    """Rules for pairs of symbols that occur at least twice in the corpus, the most frequent first.

    Re-Pair adds one rule per counting; here a counting adds up to PER_ROUND, which the next one
    finds applied. Counting goes over all sequences, each with its number of occurrences.
    """
    rules: list[tuple[int, int]] = []
    while len(rules) < MOST_RULES:
        held = list(rules)

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own, found = gr.Grammar(held), Counter()
            for batch in batches:
                for letters, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for pair in gr.digrams(own.symbols(letters)):
                        found[pair] += n
            if found:
                rows = [(a, b, n) for (a, b), n in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["a", "b", "n"])

        pairs = distinct.select("letters", "copies").mapInArrow(count, "a long, b long, n long")
        most = pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n >= 2").orderBy(F.desc("n"), "a", "b")
        fresh = [(r.a, r.b) for r in most.limit(PER_ROUND).collect()]
        if not fresh:
            break
        rules += fresh[: MOST_RULES - len(rules)]
    return rules


_grammars: dict[str, gr.Grammar] = {}


def _grammar(name: str, rules: list[tuple[int, int]]) -> gr.Grammar:
    """One grammar per worker, so that tasks share the matrices made so far."""
    if name not in _grammars:
        _grammars.clear()
        _grammars[name] = gr.Grammar(rules)
    return _grammars[name]


def _transfers(distinct: DataFrame, rules: list[tuple[int, int]], name: str) -> DataFrame:
    """(letters, copies, costs, audits): the matrix of every distinct sequence, null where there is no way."""

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _grammar(name, rules)
        for batch in batches:
            found = [own.transfer(s) for s in batch.column("letters").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("letters"),
                    batch.column("copies"),
                    pa.array([[c and c[0] for c in m] for m in found], pa.list_(pa.int64())),
                    pa.array([[c and "".join(gr.pieces(c[1])) for c in m] for m in found], pa.list_(pa.string())),
                ],
                names=["letters", "copies", "costs", "audits"],
            )

    return distinct.mapInArrow(evaluate, "letters string, copies long, costs array<long>, audits array<string>")


def _repairs(parts: DataFrame) -> DataFrame:
    """(conv_id, counts, cost, audit) from the matrices of a conversation's segments, in order."""
    ident = parts.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *STATS, "cost", "audit"]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = gr.IDENTITY[: gr.STATES]
        now = start
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                matrix = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)]
                now = gr.times(now, matrix, 1)
                if r["gaps"] is not None:
                    cost, audit = gr.finish(now)
                    out.append({**{c: r[c] for c in names[:-2]}, "cost": cost, "audit": "".join(gr.pieces(audit))})
                    now = start
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema(
        [("conv_id", pa_type(parts, "conv_id")), *((c, pa.int64()) for c in [*STATS, "cost"]), ("audit", pa.string())]
    )
    counts = ", ".join(f"{c} long" for c in [*STATS, "cost"])
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "no")
    return ordered.mapInArrow(compose, f"conv_id {ident}, {counts}, audit string")


class Replay:
    """Applies an audit to the turns of a conversation, given one at a time, and digests what it yields."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0
        self.sha, self.lines = hashlib.sha256(), 0

    def _wanted(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def _add(self, role: str, text: str) -> None:
        self.state = gr.NEXT[self.state, role[0]]
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def _insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._add(self._wanted(), "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._add(role if edit == "K" else self._wanted(), text)

    def end(self) -> str:
        self._insertions()
        return self.sha.hexdigest()


def _applied(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repairs with the SHA-256 of the repaired turns.

    The audit of a conversation is sorted in front of its turns, which then stream past one at a
    time; a SHA-256 takes its bytes in order, so this last step alone is one task per conversation.
    """
    ident = repairs.schema["conv_id"].dataType.simpleString()
    numbers = [*STATS, "cost"]
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    columns = ["conv_id", "kind", "turn", "role", "digest", "text", "copies", *numbers]
    heads = repairs.select(
        "conv_id",
        F.lit(0).alias("kind"),
        F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"),
        F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("binary").alias("digest"),
        F.col("audit").alias("text"),
        F.lit(0).cast("long").alias("copies"),
        *numbers,
    )
    rows = turns.where("copies > 0").withColumns({"kind": F.lit(1), "digest": _digest(F.col("text"))})
    rows = rows.withColumns({c: F.lit(None).cast("long") for c in numbers}).select(*columns)
    schema = pa.schema(
        [("conv_id", pa_type(repairs, "conv_id")), *((c, pa.int64()) for c in numbers), ("audit", pa.string()),
         ("repaired_sha256", pa.string())]
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, replay = None, None

        def row() -> dict:
            return {**{c: head[c] for c in ["conv_id", *numbers]}, "audit": replay.audit, "repaired_sha256": replay.end()}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if head is not None:
                        out.append(row())
                    head, replay = r, Replay(r["text"])
                else:
                    for _ in range(r["copies"]):
                        replay.turn(r["role"], r["text"])
            yield pa.RecordBatch.from_pylist(out, schema)
        if head is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)

    ordered = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order)
    counts = ", ".join(f"{c} long" for c in numbers)
    return ordered.select("conv_id", "kind", "role", "text", "copies", *numbers).mapInArrow(
        digest, f"conv_id {ident}, {counts}, audit string, repaired_sha256 string"
    )


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, counts of faults, cost, audit, repaired_sha256) of every conversation in `turns`.

    `turns` has conv_id, turn, role, text and copies (how often the row stands there, 0: it names
    its conversation only). Rows go by turn, null ones first, then by role and the text's SHA-256.
    A blank or repeated turn must go (Delete, 3); any other is kept (0), given the role user or
    assistant (Rerole, 2) or deleted, one that is cut off costs 1 more unless deleted; a turn
    without text may be put in anywhere (Insert, 2). The roles' initials must end up as `(s?(ua)+)?`.
    `audit` lists the initials of the cheapest edits, of equally cheap ones the least in ASCII.

    Null ids are one conversation; an empty role begins with nothing and is no role to keep. A
    conversation without turns has zeros, an empty audit and the SHA-256 of nothing. An empty table
    gives no rows. Conversations of any length are cut into SEGMENT turns, whose matrices are made
    wherever Spark puts them, once for all equal ones. Runs jobs when called.
    """
    spark = turns.sparkSession
    arrow_batches(spark)
    name = uuid.uuid4().hex
    folder = f"{checkpoint_dir(spark)}/repair-{name}"
    _sequences(_letters(turns)).write.parquet(f"{folder}/sequences")
    sequences = spark.read.parquet(f"{folder}/sequences")
    sequences.groupBy("letters").agg(F.count("*").alias("copies")).write.parquet(f"{folder}/distinct")
    distinct = spark.read.parquet(f"{folder}/distinct")
    parts = attach(sequences, _transfers(distinct, _rules(distinct), name), "letters", "copies")
    return _applied(turns, _repairs(parts))


def damage_and_repair(
    conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Every conversation damaged by a fixed rule (see `damaged`; nulls read as one space), then repaired."""
    return repair(damaged(named(conversations, conversation, turn, role, text)))
