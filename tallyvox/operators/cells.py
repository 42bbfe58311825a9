"""Data cells: the greedy split of each workspace's time-ordered events, as a distributed job.

The rule is sequential: an event opens a new cell when the open one holds `max_count` events, spans
`max_minutes`, or would exceed `max_tokens`. One workspace may hold a large share of all events, so
no task may walk a workspace from its first to its last event. Instead:

1. events are range-partitioned and sorted by (workspace, time, event), a unique key, so partitions
   stay even whatever the workspace sizes are, and the result is checkpointed so that both passes
   below see the same partitions;
2. every partition reports, for each number of leading events that a cell opened earlier could
   absorb (fewer than `max_count`), how its own chain of cells would end;
3. those reports, one small row per partition, are chained in partition order to find the entry
   state of every partition;
4. every partition numbers its cells from its entry state.

The result equals the sequential walk exactly. What reaches the driver is one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.functions.text import token_estimate
from tallyvox.operators.dashboard import ranked
from tallyvox.session import materialize

MAX_COUNT = 40
MAX_MINUTES = 60
MAX_TOKENS = 6000
MICROS_PER_MINUTE = 60_000_000


@dataclass(frozen=True)
class Guards:
    max_count: int = MAX_COUNT
    max_minutes: int = MAX_MINUTES
    max_tokens: int = MAX_TOKENS


def next_starts(ts: np.ndarray, tokens: np.ndarray, guards: Guards) -> np.ndarray:
    """For each event of one sorted run: where the cell after a cell opened here would open."""
    n = len(ts)
    here = np.arange(n)
    by_count = here + guards.max_count
    by_window = np.searchsorted(ts, ts + guards.max_minutes * MICROS_PER_MINUTE, side="left")
    total = np.concatenate(([0], np.cumsum(tokens, dtype=np.int64)))
    by_tokens = np.searchsorted(total, total[:-1] + guards.max_tokens, side="right") - 1
    reached = np.minimum(np.minimum(by_count, by_window), by_tokens)
    return np.minimum(np.maximum(reached, here + 1), n)


def absorbed(start_ts: int, count: int, tokens: int, ts: list, toks: list, guards: Guards) -> int:
    """How many leading events an already open cell takes before a guard closes it."""
    limit = start_ts + guards.max_minutes * MICROS_PER_MINUTE
    taken = 0
    for when, size in zip(ts, toks):
        if count >= guards.max_count or when >= limit or tokens + size > guards.max_tokens:
            break
        count, tokens, taken = count + 1, tokens + size, taken + 1
    return taken


def _endings(nxt: np.ndarray, entries: int) -> tuple[list[int], list[int]]:
    """Per entry offset: size of the last cell and number of cells opened in the run."""
    steps = nxt.tolist()
    n = len(steps)
    known: dict[int, tuple[int, int]] = {}
    for entry in range(entries):
        path, at = [], entry
        while at < n and at not in known:
            path.append(at)
            at = steps[at]
        size, opened = known.get(at, (0, 0))
        for position in reversed(path):
            if steps[position] >= n:
                size, opened = n - position, 1
            else:
                opened += 1
            known[position] = (size, opened)
    return [known[e][0] for e in range(entries)], [known[e][1] for e in range(entries)]


def _runs(ws: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(ws[1:] != ws[:-1]) + 1
    edges = [0, *cuts.tolist(), len(ws)]
    return list(zip(edges[:-1], edges[1:]))


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    frames = [b for b in batches if len(b)]
    return pd.concat(frames, ignore_index=True) if frames else None


SUMMARY_SCHEMA = (
    "part int, first_ws string, last_ws string, runs int, first_len long, "
    "head_ts array<long>, head_tokens array<long>, tail_ts array<long>, tail_tokens array<long>, "
    "end_sizes array<long>, end_opened array<long>, last_size long, last_opened long"
)


def _summarise(guards: Guards):
    keep = guards.max_count

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _whole(batches)
        if rows is None:
            return
        ws, ts = rows["ws_key"].to_numpy(), rows["ts"].to_numpy()
        tokens = rows["tokens"].to_numpy()
        spans = _runs(ws)
        (a, b), (c, d) = spans[0], spans[-1]
        sizes, opened = _endings(next_starts(ts[a:b], tokens[a:b], guards), min(keep, b - a))
        last_sizes, last_opened = _endings(next_starts(ts[c:d], tokens[c:d], guards), 1)
        tail = slice(max(c, d - keep), d)
        yield pd.DataFrame(
            {
                "part": [int(rows["part"].iloc[0])],
                "first_ws": [ws[a]],
                "last_ws": [ws[c]],
                "runs": [len(spans)],
                "first_len": [b - a],
                "head_ts": [ts[a : min(b, a + keep)].tolist()],
                "head_tokens": [tokens[a : min(b, a + keep)].tolist()],
                "tail_ts": [ts[tail].tolist()],
                "tail_tokens": [tokens[tail].tolist()],
                "end_sizes": [sizes],
                "end_opened": [opened],
                "last_size": [last_sizes[0]],
                "last_opened": [last_opened[0]],
            }
        )

    return run


def chain_entries(summaries: list, guards: Guards) -> dict[int, tuple[int, int]]:
    """Entry of every partition: leading events that belong to the open cell, cells before it."""
    keep = guards.max_count
    entries: dict[int, tuple[int, int]] = {}
    ws, tail_ts, tail_tokens, size, cells = None, [], [], 0, 0
    for s in sorted(summaries, key=lambda row: row["part"]):
        continues = s["first_ws"] == ws
        entry = 0
        if continues:
            entry = absorbed(
                tail_ts[-size], size, sum(tail_tokens[-size:]), s["head_ts"], s["head_tokens"], guards
            )
        before = cells if continues else 0
        entries[s["part"]] = (entry, before)
        if s["runs"] > 1:
            tail_ts, tail_tokens = list(s["tail_ts"]), list(s["tail_tokens"])
            size, cells = s["last_size"], s["last_opened"]
        else:
            tail_ts = ((tail_ts if continues else []) + list(s["tail_ts"]))[-keep:]
            tail_tokens = ((tail_tokens if continues else []) + list(s["tail_tokens"]))[-keep:]
            if entry >= s["first_len"]:
                size, cells = size + s["first_len"], before
            else:
                size, cells = s["end_sizes"][entry], before + s["end_opened"][entry]
        ws = s["last_ws"]
    return entries


def _number(entries: dict[int, tuple[int, int]], guards: Guards):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _whole(batches)
        if rows is None:
            return
        ws, ts = rows["ws_key"].to_numpy(), rows["ts"].to_numpy()
        tokens = rows["tokens"].to_numpy()
        numbers = np.empty(len(rows), dtype=np.int64)
        entry, before = entries[int(rows["part"].iloc[0])]
        for a, b in _runs(ws):
            steps = next_starts(ts[a:b], tokens[a:b], guards).tolist()
            opens = np.zeros(b - a, dtype=np.int64)
            at = entry
            while at < len(steps):
                opens[at] = 1
                at = steps[at]
            numbers[a:b] = before + np.cumsum(opens)
            entry, before = 0, 0
        yield rows.assign(cell_no=numbers)[["ws_key", "event_id", "cell_no", "ts", "tokens"]]

    return run


def number_cells(slim: DataFrame, guards: Guards = Guards(), partitions: int | None = None) -> DataFrame:
    """`slim(ws_key, ts, event_id, tokens)` with `cell_no`, from 1 within each workspace; `ts` in microseconds."""
    order = ["ws_key", "ts", "event_id"]
    ranged = (
        slim.repartitionByRange(partitions, *order) if partitions else slim.repartitionByRange(*order)
    )
    ordered = materialize(
        ranged.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    )
    summaries = ordered.mapInPandas(_summarise(guards), SUMMARY_SCHEMA).collect()
    entries = chain_entries(summaries, guards)
    id_type = slim.schema["event_id"].dataType.simpleString()
    return ordered.mapInPandas(
        _number(entries, guards), f"ws_key string, event_id {id_type}, cell_no long, ts long, tokens long"
    )


def assign_cells(events: DataFrame, guards: Guards = Guards(), partitions: int | None = None) -> DataFrame:
    """`events` with `tokens` and `cell_no` (from 1 within each workspace, in time order)."""
    keyed = events.withColumns(
        {
            "ws_key": F.col("ws").cast("string"),
            "ts": F.unix_micros("occurred_at"),
            "tokens": token_estimate(F.col("normalized_text")).cast("long"),
        }
    )
    numbered = number_cells(keyed.select("ws_key", "ts", "event_id", "tokens"), guards, partitions)
    return (
        keyed.drop("ts")
        .join(numbered.select("ws_key", "event_id", "cell_no"), ["ws_key", "event_id"])
        .drop("ws_key")
    )


def cells_of(assigned: DataFrame, guards: Guards = Guards()) -> DataFrame:
    """One row per cell. The reason comes from the opening of the following cell."""
    cells = assigned.groupBy("ws", "cell_no").agg(
        F.min("occurred_at").alias("window_start"),
        F.max("occurred_at").alias("window_end"),
        F.count(F.lit(1)).alias("event_count"),
        F.sum("tokens").alias("estimated_tokens"),
    )
    following = cells.select(
        "ws", (F.col("cell_no") - 1).alias("cell_no"), F.col("window_start").alias("_next")
    )
    gap = F.unix_micros("_next") - F.unix_micros("window_start")
    reason = (
        F.when(
            F.col("_next").isNull(),
            F.when(
                (F.col("event_count") == 1) & (F.col("estimated_tokens") > guards.max_tokens),
                F.lit("token_limit"),
            ).otherwise(F.lit("stream_end")),
        )
        .when(F.col("event_count") >= guards.max_count, F.lit("count_limit"))
        .when(gap >= guards.max_minutes * MICROS_PER_MINUTE, F.lit("window_limit"))
        .otherwise(F.lit("token_limit"))
    )
    return cells.join(following, ["ws", "cell_no"], "left").withColumn("close_reason", reason).drop("_next")


def data_cells(events: DataFrame, guards: Guards = Guards(), partitions: int | None = None) -> DataFrame:
    assigned = assign_cells(events, guards, partitions)
    return assigned.select("ws", "event_id", "cell_no").join(
        cells_of(assigned, guards), ["ws", "cell_no"]
    )


def cell_issues(assigned: DataFrame, links: DataFrame, samples: int = 5) -> DataFrame:
    """Mentions per (cell, topic) and the first event ids in time order."""
    rows = assigned.select("ws", "cell_no", "event_id", "occurred_at").join(
        links.select("event_id", "canonical_key"), "event_id"
    )
    per = ["ws", "cell_no", "canonical_key"]
    counted = rows.groupBy(*per).agg(F.count(F.lit(1)).alias("mention_count"))
    first = ranked(rows, samples, ["occurred_at", "event_id"], per)
    listed = first.groupBy(*per).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("occurred_at", "event_id"))), lambda x: x["event_id"]
        ).alias("sample_event_ids")
    )
    return counted.join(listed, per)


def source_window(cells: DataFrame, key: str = "ws") -> DataFrame:
    return cells.groupBy(key).agg(
        F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end")
    )


def cell_text(
    cell_issue_rows: DataFrame, events: DataFrame, cells: int = 5, cap: int = 4000
) -> DataFrame:
    """Sample texts of the first cells that have any, joined until the next one would not fit."""
    sampled = (
        cell_issue_rows.select("ws", "cell_no", F.explode("sample_event_ids").alias("event_id"))
        .distinct()
        .join(events.select("event_id", "sanitized_text"), "event_id")
        .filter(F.trim(F.coalesce("sanitized_text", F.lit(""))) != "")
    )
    first = Window.partitionBy("ws").orderBy("cell_no")
    wanted = (
        sampled.groupBy("ws", "cell_no")
        .agg(F.min_by(F.length("sanitized_text"), "event_id").alias("_size"))
        .filter(F.col("_size") <= cap)
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= cells)
        .select("ws", "cell_no")
    )
    within = Window.partitionBy("ws", "cell_no").orderBy("event_id")
    size = F.length("sanitized_text")
    fitted = (
        sampled.join(wanted, ["ws", "cell_no"])
        .withColumn("_before", F.sum(size + 1).over(within) - size - 1)
        .withColumn("_over", (F.col("_before") + size > cap).cast("int"))
        .withColumn("_stopped", F.max("_over").over(within))
        .filter("_stopped = 0")
    )
    joined = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("event_id", "sanitized_text"))),
            lambda x: F.concat(x["sanitized_text"], F.lit("\n")),
        ),
        "",
    )
    return fitted.groupBy("ws", "cell_no").agg(joined.alias("cell_text"))
