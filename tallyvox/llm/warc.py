"""WARC archives of pages with a two-level capture index.

Captures are sorted by reversed-host URL keys into compressed blocks of lines. A sparse directory
holds the first line and place of each block. A capture is found by binary search in the directory,
one range read of a block, binary search in its lines and one range read of the record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.llm.hot import attach
from tallyvox.llm.tokens import arrow_batches
from tallyvox.session import checkpoint_dir

STAMP = "20240101000000"  # capture time of pages that have none
LEAST = 1000  # bytes from which an equal payload is stored once
BLOCK_LINES = 256
FILE_BYTES = 1 << 30  # an archive file is closed once it is this long
SEGMENT_BYTES = 1 << 23  # archives are read back in pieces of about this length
READ_AHEAD = 1 << 20
HELD_BLOCKS, HELD_TARGETS = 64, 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)", re.S)
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_PORTS = {"http": "80", "https": "443"}


def escaped(text: str) -> str:
    """Blanks and control characters as %XX, so that a value fits into a header or an index line."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", text)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels in reverse, then the path and query; scheme, default port and fragment go."""
    url = escaped(url or "")
    m = _URL.match(url)
    if not m:
        return url.partition("#")[0]
    host, _, port = m[2].lower().rpartition(":")
    if not port.isdigit():
        host, port = m[2].lower(), ""
    labels = host if host.startswith("[") or host.replace(".", "").isdigit() else ",".join(reversed(host.split(".")))
    shown = "" if port in ("", _PORTS.get((m[1] or "http").lower())) else f":{port}"
    return f"{labels}{shown}){m[3] or '/'}"


def record_id(page: str | None, url: str | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {digest}')}"


def _date(stamp: str) -> str:
    return "{}-{}-{}T{}:{}:{}Z".format(stamp[:4], *(stamp[k : k + 2] for k in range(4, 14, 2)))


def _stamp(date: str) -> str:
    return re.sub(r"\D", "", date)[:14]


def _member(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, HTTP headers, payload) of a compressed record; names in lower case."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    own = _headers(head)
    http, _, payload = rest[: int(own["content-length"])].partition(b"\r\n\r\n")
    return own, _headers(http), payload


def _headers(head: bytes) -> dict[str, str]:
    lines = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, _, v in lines}


def _storage(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _placed(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """Pages with their payload, its digests, and the page and URL that an equal payload is stored under."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(page).alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
        F.sha1(payload).alias("sha1"), F.unhex(F.sha2(payload, 256)).alias("content"),
    )
    groups = (
        rows.groupBy("content")
        .agg(F.count("*").alias("copies"), F.max(F.struct("page", "url")).alias("kept"))
        .where("copies > 1")
    )
    kept = groups.select("content", "copies", F.col("kept.page").alias("kept_page"), F.col("kept.url").alias("kept_url"))
    folder = f"{checkpoint_dir(pages.sparkSession)}/warc-copies-{uuid.uuid4().hex}"
    kept.write.parquet(folder)
    return attach(rows, pages.sparkSession.read.parquet(folder), "content", "copies").withColumn(
        "revisit", (F.octet_length("payload") >= LEAST) & ~F.col("page").eqNullSafe(F.col("kept_page")) & F.col("kept_page").isNotNull()
    )


class _Archive:
    """The archive file that a task writes. Its name is new for every attempt; only committed rows name it."""

    def __init__(self, folder: str):
        self.fs, self.path = _storage(folder)
        self.name, self.out, self.at = "", None, 0

    def add(self, member: bytes) -> int:
        if self.out is None:
            self.name, self.at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
            about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _date(STAMP)),
                     ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self.at = self._put(_member(about, b"format: WARC File Format 1.1\r\n"))
        begin = self.at
        self.at += self._put(member)
        return begin

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(
    pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One record per page in gzip members, payload the html in UTF-8; returns a line per capture.

    Equal payloads of at least LEAST bytes are stored once, under the largest page id: every row of
    that id is a response, the others are revisits that refer to it. Null ids are smaller than all
    others; where all are null, all are responses. A null html is an empty payload, a null url an
    empty one. Blanks and control characters in urls are written as %XX. Repeated rows give a record
    each; an empty table gives no file; other columns are ignored.

    Texts are shuffled once, to the task that knows where an equal one is kept; payloads that make
    up much of the table are dealt over all tasks. Files go to `folder`, which all executors share;
    a failed attempt leaves a file that no line names. Runs jobs when called.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    storage, path = _storage(folder)
    storage.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(folder)
        for batch in batches:
            lines = []
            rows = zip(*(batch.column(c).to_pylist() for c in ["page", "url", "payload", "sha1", "revisit", "kept_page", "kept_url"]), strict=True)
            for page_id, link, payload, sha1, revisit, kept_page, kept_url in rows:
                shown = None if link is None else escaped(link)
                own = record_id(page_id, shown, sha1)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{own}>"),
                           ("WARC-Date", _date(STAMP)), ("WARC-Target-URI", shown), ("WARC-Payload-Digest", f"sha1:{digest}"),
                           ("X-Page-ID", None if page_id is None else escaped(page_id.replace("%", "%25")))]
                if revisit:
                    kept = None if kept_url is None else escaped(kept_url)
                    headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{record_id(kept_page, kept, sha1)}>"),
                                ("WARC-Refers-To-Target-URI", kept), ("WARC-Refers-To-Date", _date(STAMP))]
                headers.append(("Content-Type", "application/http; msgtype=response"))
                member = _member(headers, _http(len(payload)) + (b"" if revisit else payload))
                begin = archive.add(member)
                kind = "revisit" if revisit else "response"
                lines.append(f"{url_key(link)} {STAMP} {own} {kind} {archive.name} {begin} {len(member)} {sha1}")
                if archive.at >= FILE_BYTES:
                    archive.close()
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])
        archive.close()

    rows = _placed(pages, page, url, html)
    shown = rows.withColumns({c: F.col(c).cast("string") for c in ["page", "kept_page"]})
    written = shown.select("page", "url", "payload", "sha1", "revisit", "kept_page", "kept_url").mapInArrow(write, "line string")
    written.write.parquet(f"{folder}/captures")
    return spark.read.parquet(f"{folder}/captures")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorted lines in compressed blocks, and the directory (file, first, offset, length, lines) of the blocks.

    Lines are unique, so captures of one URL, however many, are dealt over files and blocks too. Each
    file has its part of the directory beside it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage, path = _storage(folder)
        name, out, at, held, places = f"captures-{uuid.uuid4().hex}.cdx.gz", None, 0, [], []

        def block(lines: list[str]) -> None:
            nonlocal out, at
            out = out or storage.open_output_stream(f"{path}/{name}", compression=None)
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = pack.compress("\n".join(lines).encode()) + pack.flush()
            out.write(data)
            places.append((name, lines[0], at, len(data), len(lines)))
            at += len(data)

        for batch in batches:
            held += batch.column(0).to_pylist()
            whole = len(held) - len(held) % block_lines
            for k in range(0, whole, block_lines):
                block(held[k : k + block_lines])
            held = held[whole:]
        if held:
            block(held)
        if out is None:
            return
        out.close()
        with storage.open_output_stream(f"{path}/{name}.dir", compression=None) as side:
            side.write("\n".join(f"{offset} {length} {first}" for _, first, offset, length, _ in places).encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*places, strict=True)], names=["file", "first", "offset", "length", "lines"]
        )

    sorted_lines = captures.select("line").repartitionByRange("line").sortWithinPartitions("line")
    sorted_lines.mapInArrow(write, "file string, first string, offset long, length long, lines long").write.parquet(
        f"{folder}/directory"
    )
    return captures.sparkSession.read.parquet(f"{folder}/directory")


class Ranges:
    """Range reads from the files of a folder; a read fetches some more, for the next one."""

    def __init__(self, folder: str, ahead: int = READ_AHEAD):
        self.fs, self.path = _storage(folder)
        self.ahead, self.name, self.file = ahead, None, None
        self.begin, self.data = 0, b""

    def get(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.name, self.file, self.data = name, self.fs.open_input_file(f"{self.path}/{name}"), b""
        at = offset - self.begin
        if at < 0 or at + length > len(self.data):
            self.begin, at = offset, 0
            self.data = self.file.read_at(max(length, self.ahead), offset)
        return self.data[at : at + length]


class CaptureIndex:
    """Looks captures up, reading only the directories and blocks that its searches meet."""

    def __init__(self, folder: str, heads: list[tuple[str, str]]):
        """`heads`: (first line, file) of every index file, see `heads`."""
        heads = sorted(heads)
        self.firsts, self.files = [h[0] for h in heads], [h[1] for h in heads]
        self.fs, self.path = _storage(folder)
        self.blocks, self.records = Ranges(folder, 0), Ranges(folder, 0)
        self.directories: OrderedDict[int, list[tuple[str, int, int]]] = OrderedDict()
        self.held: OrderedDict[tuple[int, int], list[str]] = OrderedDict()

    def _directory(self, file: int) -> list[tuple[str, int, int]]:
        if file not in self.directories:
            with self.fs.open_input_stream(f"{self.path}/{self.files[file]}.dir", compression=None) as side:
                rows = (line.split(" ", 2) for line in side.read().decode().split("\n"))
                self.directories[file] = [(first, int(offset), int(length)) for offset, length, first in rows]
            if len(self.directories) > HELD_BLOCKS:
                self.directories.popitem(last=False)
        return self.directories[file]

    def _block(self, file: int, block: int) -> list[str]:
        if (file, block) not in self.held:
            _, offset, length = self._directory(file)[block]
            data = self.blocks.get(self.files[file], offset, length)
            self.held[file, block] = zlib.decompress(data, 31).decode().split("\n")
            if len(self.held) > HELD_BLOCKS:
                self.held.popitem(last=False)
        return self.held[file, block]

    def lines(self, prefix: str) -> Iterator[str]:
        """Lines that begin with `prefix`, in order."""
        file = max(bisect_right(self.firsts, prefix) - 1, 0)
        if not self.files:
            return
        block = max(bisect_right([d[0] for d in self._directory(file)], prefix) - 1, 0)
        k = bisect_left(self._block(file, block), prefix)
        while True:
            rows = self._block(file, block)
            while k < len(rows):
                if not rows[k].startswith(prefix):
                    return
                yield rows[k]
                k += 1
            k, block = 0, block + 1
            if block == len(self._directory(file)):
                file, block = file + 1, 0
                if file == len(self.files):
                    return

    def captures(self, url: str) -> Iterator[str]:
        return self.lines(f"{url_key(url)} ")

    def record(self, line: str) -> tuple[dict[str, str], dict[str, str], bytes]:
        name, offset, length = line.split(" ")[4:7]
        return parsed(self.records.get(name, int(offset), int(length)))

    def response(self, url: str | None, stamp: str, ident: str) -> tuple[dict[str, str], dict[str, str], bytes]:
        """The response record of that URL, time and id."""
        for line in self.lines(f"{url_key(url)} {stamp} {ident} response "):
            return self.record(line)
        raise KeyError(f"no response {ident} of {url}")


def heads(directory: DataFrame) -> list[tuple[str, str]]:
    """(first line, file) of every index file; there is one per task that wrote the index."""
    return [(r.first, r.file) for r in directory.groupBy("file").agg(F.min("first").alias("first")).collect()]


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Every capture of the index, read back: (page, url, record_type, payload_bytes, payload_digest, refers_to).

    Blocks of the index say where records stand; these are read in the order of the files. A revisit
    is looked up: its payload is that of the response it refers to, found through the index. `page`
    and `refers_to` are strings. `payload` adds the full payload. A payload that does not have the
    digest of its record is an error.
    """
    arrow_batches(spark)
    directory = spark.read.parquet(f"{folder}/directory")
    tops = heads(directory)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder, 0)
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = zlib.decompress(ranges.get(file, offset, length), 31).decode().split("\n")
                name, begin, size = zip(*(line.split(" ")[4:7] for line in lines), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name), pa.array(list(map(int, begin))), pa.array(list(map(int, size)))],
                    names=["file", "offset", "length"],
                )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, index = Ranges(folder), CaptureIndex(folder, tops)
        known: dict[str, tuple] = {}
        for batch in batches:
            rows, size = [], 0
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, _, body = parsed(ranges.get(file, offset, length))
                refers = None
                if own["warc-type"] == "revisit":
                    ident = own["warc-refers-to"].strip("<>")
                    if ident not in known:
                        if len(known) >= HELD_TARGETS:
                            known.clear()
                        target, _, full = index.response(own.get("warc-refers-to-target-uri"), _stamp(own["warc-refers-to-date"]), ident)
                        known[ident] = (target.get("x-page-id"), len(full), hashlib.sha1(full).hexdigest(), full if payload else None)
                    refers, n, digest, body = known[ident]
                else:
                    n, digest = len(body), hashlib.sha1(body).hexdigest()
                if base64.b32encode(bytes.fromhex(digest)).decode() != own["warc-payload-digest"].removeprefix("sha1:"):
                    raise ValueError(f"payload of {own['warc-record-id']} does not have its digest")
                shown = [None if p is None else unquote(p) for p in (own.get("x-page-id"), refers)]
                rows.append((shown[0], own.get("warc-target-uri"), own["warc-type"], n, digest, shown[1], *([body] if payload else [])))
                size += n if payload else 0
                if size > READ_AHEAD:
                    yield _table(rows, names, types)
                    rows, size = [], 0
            yield _table(rows, names, types)

    names = ["page", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payload else [])]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), *([pa.binary()] if payload else [])]
    blocks = directory.select("file", "offset", "length").repartition("file", "offset")
    found = blocks.mapInArrow(places, "file string, offset long, length long")
    ordered = found.repartition("file", F.floor(F.col("offset") / SEGMENT_BYTES)).sortWithinPartitions("file", "offset")
    schema = "page string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    return ordered.mapInArrow(read, schema + (", payload binary" if payload else ""))


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def find_captures(urls: DataFrame, folder: str, url: str = "url") -> DataFrame:
    """(url, stamp, record_type, payload) of every capture of each wanted URL, by search in the index.

    Tasks take the URLs in the order of their keys, so that neighbours share blocks.
    """
    spark = urls.sparkSession
    arrow_batches(spark)
    tops = heads(spark.read.parquet(f"{folder}/directory"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, tops)
        types = [pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for wanted in sorted(batch.column(0).to_pylist(), key=url_key):
                for line in index.captures(wanted):
                    own, _, body = index.record(line)
                    if own["warc-type"] == "revisit":
                        body = index.response(
                            own.get("warc-refers-to-target-uri"), _stamp(own["warc-refers-to-date"]), own["warc-refers-to"].strip("<>")
                        )[2]
                    yield _table([(wanted, line.split(" ")[1], own["warc-type"], body)], ["url", "stamp", "record_type", "payload"], types)

    wanted = urls.select(F.col(url).cast("string").alias("url")).where("url is not null").distinct()
    return wanted.mapInArrow(find, "url string, stamp string, record_type string, payload binary")


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names."""
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def write_and_read(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page id, payload_bytes, payload_digest, record_type, refers_to) of archives of the pages, read back."""
    spark, kind = pages.sparkSession, pages.schema[page].dataType
    folder = archive_folder(spark)
    build_index(write_archives(pages, folder, page, url, html), folder)
    return read_archives(spark, folder).select(
        F.col("page").cast(kind).alias(page), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM g"""
