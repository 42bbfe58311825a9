"""Feedback files: scan, header check, preview, column mapping, file manifest."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvox.functions.text import PHONE_PATTERN_CN, is_blank, java_trim, pii_mask
from tallyvox.operators.ordering import numbered
from tallyvox.sources.csv_records import records
from tallyvox.sources.versions import Storage

BOM = chr(0xFEFF)
REQUIRED_FIELDS = ["feedback_text", "occurred_at", "source", "external_ref"]
DIMENSION_KEY = re.compile(r"[a-z][a-z0-9_]{0,39}")
CORRUPT = "_corrupt"
CELLS = {
    "escape": '"',
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
}


class InvalidHeader(ValueError):
    """A blank, duplicate or missing header."""


@dataclass
class ImportMapping:
    """Which source column fills which field."""

    feedback_text: str | None
    occurred_at: str | None
    source: str | None
    external_ref: str | None
    dimensions: dict[str, str] = field(default_factory=dict)

    def required(self) -> list[tuple[str, str | None]]:
        return [(name, getattr(self, name)) for name in REQUIRED_FIELDS]


def validate_headers(names: list[str]) -> list[str]:
    cleaned = [n[1:] if n and n.startswith(BOM) else n for n in names]
    if not cleaned or any(not (n or "").strip() for n in cleaned) or len(set(cleaned)) != len(cleaned):
        raise InvalidHeader("CSV headers must be present and unique")
    return cleaned


def _header(spark: SparkSession, path: str) -> list[str]:
    first = (
        spark.read.option("header", "false")
        .option("ignoreLeadingWhiteSpace", "true")
        .option("ignoreTrailingWhiteSpace", "true")
        .option("nullValue", "\x00")
        .csv(path)
        .limit(1)
        .collect()
    )
    if not first:
        raise InvalidHeader("empty file")
    return [value or "" for value in first[0]]


def read_feedback_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All-string scan with the file name and a sequence that grows in file order.

    `multi_line` allows line breaks inside quoted cells. Files of any size are split either way (see
    `csv_records`): lines end with a line feed, with or without a carriage return. All files must
    have the header of the first, in its order; another one is an error when the file is read.
    """
    names = validate_headers(_header(spark, path))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    if multi_line:
        return _read_records(spark, path, names, schema)
    raw = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("encoding", "UTF-8")
        .options(**CELLS)
        .csv(path)
    )
    return raw.withColumn("_file", F.input_file_name()).withColumn(
        "_seq", F.monotonically_increasing_id()
    )


def _read_records(spark: SparkSession, path: str, names: list[str], schema: T.StructType) -> DataFrame:
    """Glued records, each parsed by Spark's own CSV parser; the first of a file is its header."""
    kinds = ", ".join(f"`{c.replace('`', '``')}` string" for c in schema.names)
    parsed = records(spark, path).withColumn("_cells", F.from_csv("record", kinds, {**CELLS, "multiLine": "true"}))
    cell = lambda c: F.col("_cells").getField(c)
    shown = [F.coalesce(cell(c), F.lit("")) for c in names]
    shown[0] = F.regexp_replace(shown[0], f"^{BOM}", "")
    same = (F.array(*shown) == F.array(*map(F.lit, names))) & cell(CORRUPT).isNull()
    wrong = F.raise_error(F.concat(F.lit("CSV header of another file: "), "file", F.lit(": "), "record")).cast("boolean")
    rows = parsed.where(F.when(~F.col("head"), F.lit(True)).when(same, F.lit(False)).otherwise(wrong))
    return rows.select(*(cell(c).alias(c) for c in schema.names), F.col("file").alias("_file"), F.col("position").alias("_seq"))


def record_numbers(df: DataFrame) -> DataFrame:
    """`row_no`: the record's number in its file, from 1, however many tasks read the file."""
    return numbered(df, ["_file"], ["_seq"], "row_no")


def preview(df: DataFrame, n: int = 5, phone: str = PHONE_PATTERN_CN) -> DataFrame:
    columns = [c for c in df.columns if not c.startswith("_")]
    masked = [pii_mask(F.col(f"`{c}`").cast("string"), phone).alias(c) for c in columns]
    return df.limit(n).select(*masked)


def apply_mapping(df: DataFrame, mapping: ImportMapping) -> DataFrame:
    """The four fields plus a map of non-blank dimensions; bookkeeping columns pass through."""
    fields = [F.col(f"`{column}`").alias(name) for name, column in mapping.required()]
    entries = []
    for key, column in mapping.dimensions.items():
        entries += [F.lit(key), java_trim(pii_mask(F.col(f"`{column}`").cast("string")))]
    if entries:
        dimensions = F.map_filter(F.create_map(*entries), lambda _, v: ~is_blank(v))
    else:
        dimensions = F.create_map().cast("map<string,string>")
    kept = [F.col(c) for c in df.columns if c.startswith("_") and c != CORRUPT]
    return df.select(*fields, dimensions.alias("dimensions"), *kept)


def mapping_violations(mapping: ImportMapping, names: list[str]) -> list[tuple[str, str]]:
    found = []
    chosen = mapping.required() + [(f"dimensions.{k}", c) for k, c in mapping.dimensions.items()]
    for name, column in chosen:
        if column is None or not column.strip():
            found.append((name, "必须选择 CSV 列"))
        elif column not in names:
            found.append((name, "映射列不存在于当前文件表头"))
    used: set[str] = set()
    for name, column in mapping.required():
        if column and column.strip():
            if column in used:
                found.append((name, "不能与其它必填字段复用同一列"))
            used.add(column)
    if len(used) != len(REQUIRED_FIELDS):
        found.append(("mapping", "四个必填字段必须映射到不同的 CSV 列"))
    for key in mapping.dimensions:
        if not DIMENSION_KEY.fullmatch(key):
            found.append((f"dimensions.{key}", "维度键必须为小写字母、数字或下划线"))
    return found


def validate_mapping(spark: SparkSession, mapping: ImportMapping, names: list[str]) -> DataFrame:
    return spark.createDataFrame(mapping_violations(mapping, names), "field string, reason string")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256, valid) of every file of a folder or pattern: valid are non-empty ones named *.csv.

    Tasks read a file block by block through the digest, so a file of any size costs BLOCK bytes of
    memory. Where only Spark's own readers know the file system, the content comes from them, which
    limits a file to 2 GB. Files whose name begins with a dot or underline are left out.
    """
    listed = spark.createDataFrame(Storage(spark, path).files(), "path string, length long")
    if Storage(spark, path).scheme() in ARROW_SYSTEMS:
        hashed = listed.repartition("path").mapInArrow(_digests, "path string, length long, sha256 string")
    else:
        read = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("_sha"))
        nothing = F.sha2(F.lit(b""), 256)  # Spark does not read empty files
        hashed = listed.join(read, "path", "left").select("path", "length", F.coalesce("_sha", nothing).alias("sha256"))
    name = F.element_at(F.split("path", "/"), -1)
    return hashed.select(
        name.alias("name"),
        F.col("length").alias("size"),
        "sha256",
        ((F.col("length") > 0) & F.lower(name).endswith(".csv")).alias("valid"),
    )


BLOCK = 8 << 20
ARROW_SYSTEMS = {"file", "hdfs", "gs", "s3"}


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark shows it, which is not escaped like a URI."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(quote(uri, safe=":/@"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for uri in batch.column(0).to_pylist():
            storage, path = _opened(uri)
            sha = hashlib.sha256()
            with storage.open_input_stream(path, compression=None) as stream:
                while block := stream.read(BLOCK):
                    sha.update(block)
            found.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["path", "length", "sha256"])
