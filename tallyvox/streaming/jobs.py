"""Streaming forms of ingest, daily counts, data cells and baselines.

What a batch has to know of earlier ones is keyed state, or a small table of the batch before; no
job reads its own output back. Sinks are cut by batch id and overwritten per batch id, so a batch
that is run again after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from tallyvox.functions.text import token_estimate
from tallyvox.operators import baseline as bl
from tallyvox.operators import buckets as bk
from tallyvox.operators.cells import MICROS_PER_MINUTE, Guards, cells_of, number_cells
from tallyvox.operators.ingest import EVENT_KEY, to_events
from tallyvox.session import materialize
from tallyvox.sources.feedback_csv import ImportMapping, apply_mapping
from tallyvox.sources.versions import RunLog, Storage

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed_state(spark: SparkSession) -> None:
    """State that outgrows an executor's memory goes to its disk, and to the checkpoint as changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


class _FirstOfKey(StatefulProcessor):
    """Passes the first row of a key on and marks the others; a key is remembered for `days`, or for good."""

    def __init__(self, columns: list[str], days: float | None):
        self.columns, self.days = columns, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        keep = None if self.days is None else int(self.days * 86_400_000)
        self.seen = handle.getValueState("seen", "here boolean", keep)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        best, known = None, None
        for batch in rows:
            bad = batch["error"].notna()
            if bad.any():
                yield batch.loc[bad, self.columns].assign(outcome="failed")
            good = batch[~bad]
            if len(good):
                known = self.seen.exists() if known is None else known
                first = good.sort_values(["file", "record"]).iloc[:1]
                if best is None or tuple(first[["file", "record"]].iloc[0]) < tuple(best[["file", "record"]].iloc[0]):
                    best = first
        if best is not None and not known:
            self.seen.update((True,))
            yield best[self.columns].assign(outcome="imported")

    def close(self) -> None:
        pass


def _one_per_key(keys: list[str]):
    """Numbers the records of each file and drops good rows whose key came earlier in the same batch of rows.

    So a key with many rows costs one row per batch of rows. Rejected rows get a key of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: dict[str, int] = {}
        for batch in batches:
            before = batch["file"].map(lambda f: read.get(f, 0))
            batch["record"] = batch.groupby("file").cumcount() + before
            for file, n in batch["file"].value_counts().items():
                read[file] = read.get(file, 0) + int(n)
            bad = batch["error"].notna()
            batch["apart"] = (batch["file"] + "#" + batch["record"].astype(str)).where(bad, "")
            yield batch[~batch.duplicated([*keys, "apart"])]

    return run


def stream_ingest(
    spark: SparkSession,
    path: str,
    mapping: ImportMapping,
    columns: list[str],
    target: str,
    ws: Column,
    source_id: Column,
    max_files: int = 100,
    remember_days: float | None = None,
) -> DataStreamWriter:
    """CSV files to events; a reference seen in an earlier batch or earlier in this one is dropped.

    References live in keyed state, by source and reference hash, so a batch costs what it holds
    however many came before; `remember_days` lets them expire, by the clock. Of rows of one
    reference in a batch the first in the order of file name and record stays. Rejected rows go to
    `<target>_rejected`, with the number of the record in its file, from 0.
    """
    _keyed_state(spark)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (
        spark.readStream.schema(schema)
        .option("header", "true")
        .option("maxFilesPerTrigger", max_files)
        .option("ignoreLeadingWhiteSpace", "true")
        .option("ignoreTrailingWhiteSpace", "true")
        .option("escape", '"')
        .option("multiLine", "true")
        .csv(path)
    )
    rows = raw.withColumns({"_file": F.col("_metadata.file_path"), "_seq": F.lit(0).cast("long")})
    events = to_events(apply_mapping(rows, mapping)).withColumns({"ws": ws, "source_id": source_id})
    events = events.withColumnsRenamed({"_file": "file", "_seq": "record"})
    keyed = events.mapInPandas(
        _one_per_key(EVENT_KEY), T.StructType([*events.schema.fields, T.StructField("apart", T.StringType())])
    )
    marked = keyed.groupBy(*EVENT_KEY, "apart").transformWithStateInPandas(
        _FirstOfKey(events.columns, remember_days),
        T.StructType([*events.schema.fields, T.StructField("outcome", T.StringType())]),
        "Append",
        "None" if remember_days is None else "ProcessingTime",
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        good = held.filter("outcome = 'imported'").drop("error", "outcome", "record", "file")
        _write_batch(good, target, batch_id)
        _write_batch(held.filter("outcome = 'failed'").select(F.col("file").alias("_file"), F.col("record").alias("_seq"), "error"), f"{target}_rejected", batch_id)
        held.unpersist()

    return marked.writeStream.foreachBatch(handle)


def _merged_buckets(log: RunLog, runs: list[dict]) -> DataFrame:
    deltas = log.spark.read.parquet(*[log.path(r, "counts") for r in runs])
    return bk.bucket_merge(deltas.limit(0), deltas)


def stream_buckets(links: DataFrame, target: str) -> DataStreamWriter:
    """Daily counts as additive deltas per batch, so late events still reach their day.

    Deltas are runs behind one pointer and merged as they add up (see `sources.versions`): there are
    at most FANOUT per level, and a reader sees one version.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        log = RunLog(batch.sparkSession, target)
        log.append({"counts": bk.bucket_counts(batch)}, batch_id)
        log.compact(lambda runs: {"counts": _merged_buckets(log, runs)})

    return links.writeStream.foreachBatch(handle)


def current_buckets(spark: SparkSession, target: str) -> DataFrame:
    """Counts over all runs of the newest version."""
    log = RunLog(spark, target)
    return _merged_buckets(log, log.version()["runs"])


CELL_COLUMNS = ["ws", "cell_no", "window_start", "window_end", "event_count", "estimated_tokens", "close_reason"]
WAITING = "ws_key string, ts long, event_id {id}, tokens long, open boolean, before long, last_ts long"


def stream_cells(
    events: DataFrame, target: str, guards: Guards = Guards(), lateness: str = "10 minutes", partitions: int | None = None
) -> DataStreamWriter:
    """Closed cells, as they close, in `<target>/cells`. The open cell of a workspace closes once time has passed it.

    Time is the newest event less `lateness`. Events wait until it has passed them and are then
    split in the order of time and id, so an event that is late by less lands in its cell; events
    behind it are dropped. `<target>/state` holds, for the batch before, the waiting events and the
    events of each workspace's open cell, at most `max_count`, and its number of closed cells.

    A cell starts with the first event of the open one, so a batch is the open events and the ready
    ones behind each other, split by the same job as a whole table: range partitions report how
    their chains end for every possible entry and are chained. A workspace with all events runs in
    as many tasks as its events ask for.
    """
    ident = events.schema["event_id"].dataType
    schema = T._parse_datatype_string(WAITING.format(id=ident.simpleString()))
    slim = events.select(
        F.col("ws").cast("string").alias("ws_key"),
        F.unix_micros("occurred_at").alias("ts"),
        "event_id",
        token_estimate(F.col("normalized_text")).cast("long").alias("tokens"),
    )
    span_of = f"unix_micros(timestamp_micros(0) + INTERVAL '{lateness}')"
    allowed = events.sparkSession.range(1).select(F.expr(span_of)).first()[0]
    span = guards.max_minutes * MICROS_PER_MINUTE

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, state = batch.sparkSession, f"{target}/state"
        files = Storage(spark, target)
        earlier = sorted(int(n.split("=")[1]) for n in files.names("state") if n.startswith("batch_id="))
        earlier = [n for n in earlier if n < batch_id]
        held = spark.read.schema(schema).parquet(f"{state}/batch_id={earlier[-1]}") if earlier else spark.createDataFrame([], schema)
        newest = held.agg(F.max("last_ts")).first()[0]
        fresh = batch.withColumns({"open": F.lit(False), "before": F.lit(0).cast("long"), "last_ts": F.lit(None).cast("long")})
        if newest is not None:
            fresh = fresh.where(F.col("ts") > F.lit(newest - allowed))
        rows = materialize(held.where("ts is not null").unionByName(fresh.select(*schema.names)))
        top = max((t for t in (newest, rows.agg(F.max("ts")).first()[0]) if t is not None), default=None)
        if top is None:
            return
        passed = top - allowed
        ready = rows.where((F.col("ts") <= passed) | F.col("open"))
        number = number_cells(ready.select("ws_key", "ts", "event_id", "tokens"), guards, partitions)
        # Every workspace has a row without an event that holds its number of closed cells.
        before = held.where("ts is null").select("ws_key", "before")
        numbered = materialize(
            number.join(before, "ws_key", "left").withColumn("cell_no", F.col("cell_no") + F.coalesce("before", F.lit(0))).drop("before")
        )
        cells = cells_of(numbered.withColumns({"ws": F.col("ws_key"), "occurred_at": F.timestamp_micros("ts")}), guards)
        ending = F.unix_micros("window_start") + span
        cells = materialize(
            cells.withColumn("_last", F.col("cell_no") == F.max("cell_no").over(Window.partitionBy("ws")))
            .withColumn("_open", F.col("_last") & (ending >= F.lit(passed)))
        )
        reason = F.when(F.col("_last"), "window_limit").otherwise(F.col("close_reason"))
        done = cells.where("NOT _open").withColumn("close_reason", reason).select(*CELL_COLUMNS)
        _write_batch(done, f"{target}/cells", batch_id)
        open_cells = cells.where("_open").select(F.col("ws").alias("ws_key"), "cell_no")
        opened = numbered.join(open_cells, ["ws_key", "cell_no"], "left_semi").withColumn("open", F.lit(True))
        waiting = rows.where((F.col("ts") > passed) & ~F.col("open"))
        closed = cells.groupBy(F.col("ws").alias("ws_key")).agg(
            (F.max("cell_no") - F.max(F.col("_open").cast("long"))).alias("closed")
        )
        counts = before.join(closed, "ws_key", "full").select("ws_key", F.coalesce("closed", "before").alias("before"))
        opened, waiting = (d.withColumn("before", F.lit(0).cast("long")).select(*schema.names[:-1]) for d in (opened, waiting))
        nothing = {"ts": F.lit(None).cast("long"), "event_id": F.lit(None).cast(ident), "tokens": F.lit(0).cast("long"), "open": F.lit(False)}
        marks = counts.withColumns(nothing).select(*schema.names[:-1])
        after = opened.unionByName(waiting).unionByName(marks).withColumn("last_ts", F.lit(top))
        _write_batch(after.select(*schema.names), state, batch_id)
        for n in earlier[:-1]:
            files.delete(f"state/batch_id={n}")

    return slim.writeStream.foreachBatch(handle)


STATE_COLUMNS = (
    "ws {ws}, canonical_key string, bucket_start timestamp, feedback_count long, prior_active int, prior_ewma double, "
    "prior_variance double, active_buckets int, ewma double, variance double, std double, status string"
)
PROFILE = "active int, ewma double, variance double, last_bucket timestamp"


class _Profile(StatefulProcessor):
    """Continues the baseline of a topic over the days that have closed, from its saved profile."""

    def __init__(self, alpha: float, min_days: int):
        self.alpha, self.min_days = alpha, min_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.profile = handle.getValueState("profile", PROFILE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("bucket_start")
        active, ewma, variance, last = self.profile.get() if self.profile.exists() else (0, 0.0, 0.0, None)
        out = []
        for start, count in zip(days["bucket_start"], days["feedback_count"], strict=True):
            if last is not None and start <= pd.Timestamp(last):
                continue
            before, n = (active, ewma, variance), float(count)
            if active == 0:
                active, ewma, variance = 1, n, 0.0
            else:
                delta = n - ewma
                variance = (1 - self.alpha) * (variance + self.alpha * delta * delta)
                active, ewma = active + 1, ewma + self.alpha * delta
            last = start.to_pydatetime()
            status = "active" if active >= self.min_days else "baseline_building"
            out.append((*key, start, count, *before, active, ewma, variance, math.sqrt(variance), status))
        if out:
            self.profile.update((active, ewma, variance, last))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE_COLUMNS.split(", ")])

    def close(self) -> None:
        pass


def stream_baseline_alerts(
    links: DataFrame, target: str, lateness: str = "1 day", against: str = "prior", alpha: float = 0.3, min_days: int = 3
) -> DataStreamWriter:
    """Baselines and alerts of every day that the watermark has closed; alerts go to `<target>/alerts`.

    Days are counted by the windowed aggregate, which combines before the shuffle and lets a day go
    when the watermark passes its end; late events of closed days are dropped there. A topic's
    profile is keyed state, one row, which its closed days continue in their order.
    """
    _keyed_state(links.sparkSession)
    closed = (
        links.withWatermark("occurred_at", lateness)
        .groupBy("ws", "canonical_key", F.window("occurred_at", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("feedback_count"))
        .select("ws", "canonical_key", F.col("w.start").alias("bucket_start"), "feedback_count")
    )
    columns = STATE_COLUMNS.format(ws=links.schema["ws"].dataType.simpleString())
    states = closed.groupBy(*bl.ISSUE).transformWithStateInPandas(_Profile(alpha, min_days), columns, "Append", "None")

    def handle(batch: DataFrame, batch_id: int) -> None:
        judged = bl.alert_detect(bl.issue_class(batch), against=against)
        _write_batch(judged.filter("fires"), f"{target}/alerts", batch_id)

    return states.writeStream.outputMode("append").foreachBatch(handle)


def current_profiles(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Profiles of all topics, from the state under a stream's checkpoint folder."""
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "profile").load(checkpoint)
    return state.select("key.*", "value.*")
