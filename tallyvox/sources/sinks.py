"""Sinks: fact tables, report documents, corpus manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.session import materialize
from tallyvox.sources.versions import RunLog

PREVIEW_CHARS = 120


def commit_facts(spark: SparkSession, path: str, tables: dict[str, DataFrame], workspaces: DataFrame) -> int:
    """Replace all facts of `workspaces(ws)` by those of `tables`, in one commit; returns its version.

    A workspace of the list for which a table has no row ends up without rows there; workspaces that
    are not on the list keep theirs, and rows of them in `tables` are an error. All tables are staged
    first and become visible together (see `versions`), so a commit that fails leaves the old facts.
    Rows are range-partitioned by workspace and a hash of the row, so a workspace is written by as
    many tasks as its share of the rows asks for. A null workspace is none.
    """
    log = RunLog(spark, path)
    covered = materialize(workspaces.select("ws").where("ws is not null").distinct())
    staged = {}
    for name, df in tables.items():
        owned = df.join(covered.withColumn("_covered", F.lit(True)), "ws", "left")
        foreign = F.raise_error(F.concat(F.lit(f"{name}: workspace is not part of the commit: "), F.coalesce(F.col("ws").cast("string"), F.lit("null"))))
        checked = owned.withColumn("ws", F.when(F.col("_covered"), F.col("ws")).otherwise(foreign.cast(df.schema["ws"].dataType)))
        others = [c for c in df.columns if c != "ws"]
        staged[name] = checked.select(*df.columns).repartitionByRange("ws", F.xxhash64(*others))
    version = log.append({**staged, WORKSPACES: covered})
    log.compact(lambda runs: _newest(log, runs))
    return version["number"]


WORKSPACES = "_workspaces"


def _owners(log: RunLog, runs: list[dict]) -> DataFrame:
    """(ws, _run): the newest of the runs that covers a workspace."""
    covered = [log.spark.read.parquet(log.path(r, WORKSPACES)).withColumn("_run", F.lit(n)) for n, r in enumerate(runs)]
    return reduce(DataFrame.unionByName, covered).groupBy("ws").agg(F.max("_run").alias("_run"))


def _visible(log: RunLog, runs: list[dict], table: str) -> DataFrame:
    parts = [
        log.spark.read.parquet(log.path(r, table)).withColumn("_run", F.lit(n))
        for n, r in enumerate(runs)
        if log.files.exists(f"{r['name']}/{table}")
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.join(_owners(log, runs), ["ws", "_run"], "left_semi").drop("_run")


def _newest(log: RunLog, runs: list[dict]) -> dict[str, DataFrame]:
    """One run that stands for several: of each workspace what the newest of them says."""
    names = {n for r in runs for n in log.files.names(r["name"])} - {WORKSPACES}
    return {**{n: _visible(log, runs, n) for n in names}, WORKSPACES: _owners(log, runs).select("ws")}


def read_facts(spark: SparkSession, path: str, table: str, version: int | None = None) -> DataFrame:
    """The facts of all workspaces in one version of the commits, by default the newest."""
    log = RunLog(spark, path)
    return _visible(log, log.version(version)["runs"], table)


def report_json(summary: DataFrame, risks: DataFrame, evidence: DataFrame) -> DataFrame:
    """One document per report. `risks` and `evidence` are report lists, already cut to top rows."""
    risk_list = risks.groupBy("ws").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("risk_pos", "issue", "level", "score"))),
            lambda r: F.struct(
                r["issue"].alias("issue"), r["level"].alias("level"), r["score"].alias("score")
            ),
        ).alias("risks")
    )
    evidence_list = evidence.groupBy("ws").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("evidence_pos", "reference", "title"))),
            lambda r: F.struct(r["reference"].alias("reference"), r["title"].alias("title")),
        ).alias("evidence")
    )
    document = F.struct(
        "report",
        F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generatedAt"),
        F.struct(
            F.date_format("range_start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start"),
            F.date_format("range_end", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("end"),
        ).alias("timeRange"),
        "risks",
        "evidence",
    )
    return (
        summary.join(risk_list, "ws", "left")
        .join(evidence_list, "ws", "left")
        .select("ws", F.to_json(document).alias("report_json"))
    )


def corpus_manifest(docs: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """One manifest entry per document: versions in order, chunks in order, previews and counts."""
    preview = F.substring(F.regexp_replace("content", r"\s+", " "), 1, PREVIEW_CHARS)
    chunk_lists = (
        chunks.select(
            "document_id",
            "version_no",
            F.struct(
                "chunk_no",
                "chunk_id",
                F.col("heading").alias("section_heading"),
                preview.alias("content_preview"),
            ).alias("chunk"),
        )
        .groupBy("document_id", "version_no")
        .agg(F.array_sort(F.collect_list("chunk")).alias("chunks"))
    )
    version_lists = (
        versions.join(chunk_lists, ["document_id", "version_no"], "left")
        .select(
            "document_id",
            F.struct(
                "version_no",
                "status",
                F.coalesce(F.size("chunks"), F.lit(0)).alias("chunk_count"),
                "chunks",
            ).alias("version"),
        )
        .groupBy("document_id")
        .agg(F.array_sort(F.collect_list("version")).alias("versions"))
    )
    return (
        docs.join(version_lists, "document_id", "left")
        .select(
            "document_id",
            F.coalesce(F.size("versions"), F.lit(0)).alias("version_count"),
            F.coalesce(
                F.aggregate("versions", F.lit(0), lambda n, v: n + v["chunk_count"]), F.lit(0)
            ).alias("chunk_count"),
            F.to_json(F.struct("document_id", "title", "document_type", "versions")).alias(
                "manifest_json"
            ),
        )
    )
