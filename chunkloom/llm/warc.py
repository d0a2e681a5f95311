"""Operator 2: WARC transactions assembled through concurrent-to identifiers.

``read_warc`` streams records out of WARC files (plain, or gzip with a member a record); ``assemble`` joins
request, response and metadata records into one nested row per capture.

Plan: one scan writes the links and the small records (all but responses) to a checkpoint; labels spread
along concurrent-to links, whichever side names the other, until nothing more is reached (one or two narrow
joins of ids as a rule). A second scan streams the captures, whose payloads are shuffled once, into a hash
join with their gathered small records. Payloads are never sorted and never collected into groups.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.plans.lineage import cut

CAPTURES = ("response", "resource", "revisit", "conversion")
SCHEMA = (
    "file string, offset bigint, warc_type string, record_id string, concurrent_to array<string>, target_uri string, warc_date string,"
    " headers map<string,array<string>>, http_start string, http_headers map<string,array<string>>, payload binary, truncated boolean"
)
_ARROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())),
    ("target_uri", pa.string()), ("warc_date", pa.string()), ("headers", pa.map_(pa.string(), pa.list_(pa.string()))), ("http_start", pa.string()),
    ("http_headers", pa.map_(pa.string(), pa.list_(pa.string()))), ("payload", pa.binary()), ("truncated", pa.bool_()),
])
BATCH_BYTES = 8 << 20


def _fields(head: bytes) -> list[tuple[str, str]]:
    """Header lines as (lower-case name, value); a line that begins with white space continues the last."""
    out: list[tuple[str, str]] = []
    for line in head.split(b"\n"):
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {text.strip()}"
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def _dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Start line, headers and payload of an HTTP message; transfer and gzip codings are undone."""
    m = re.search(rb"\r?\n\r?\n", block)
    head, body = (block[: m.start()], block[m.end() :]) if m else (block, b"")
    start, _, rest = head.partition(b"\n")
    fields = _fields(rest)
    coding = dict(fields)
    if coding.get("transfer-encoding", "").lower() == "chunked":
        body = _dechunk(body)
    if coding.get("content-encoding", "").lower() in ("gzip", "x-gzip"):
        try:
            body = zlib.decompressobj(31).decompress(body)
        except zlib.error:
            pass
    return start.rstrip(b"\r").decode("utf-8", "replace"), fields, body


def _by_name(fields: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    out: dict[str, list[str]] = {}
    for name, value in fields:
        out.setdefault(name, []).append(value)
    return list(out.items())


def row_of(file: str, offset: int, fields: list[tuple[str, str]], block: bytes, length: int | None) -> dict:
    """The row of a record; headers have the values of each name in their order."""
    h = dict(fields)
    kind = h.get("warc-type")
    is_http = "application/http" in h.get("content-type", "") and kind in ("request", "response", "revisit")
    start, http, payload = http_parts(block) if is_http else (None, [], block)
    return {
        "file": file, "offset": offset, "warc_type": kind, "record_id": h.get("warc-record-id"), "concurrent_to": [v for k, v in fields if k == "warc-concurrent-to"],
        "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date"), "headers": _by_name(fields), "http_start": start,
        "http_headers": _by_name(http), "payload": payload, "truncated": "warc-truncated" in h or length is not None and len(block) < length,
    }


def parse(stream: BinaryIO, file: str = "") -> Iterator[dict]:
    """Rows of the records of an uncompressed stream, one at a time; what isn't a record is skipped line by line."""
    offset = 0
    while line := stream.readline():
        at, offset = offset, offset + len(line)
        if not line.startswith(b"WARC/"):
            continue
        head = []
        while (line := stream.readline()).strip():
            offset += len(line)
            head.append(line)
        offset += len(line)
        fields = _fields(b"".join(head))
        try:
            length = max(0, int(dict(fields).get("content-length", "0")))
        except ValueError:
            length = 0
        block = stream.read(length)
        offset += len(block)
        yield row_of(file, at, fields, block, length)


def batched(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += len(r["payload"]) + 500
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(some, _ARROW)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, _ARROW)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files of ``path`` (a file, folder or glob), in SCHEMA.

    Files are streamed by the executors record by record, so memory follows the largest record. Of a file that
    breaks off or is damaged, plain or gzip, the records before that place are given and the one it lies in
    with what could be read, marked ``truncated``. An empty file gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.repartition(max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism)), "path")

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", name) else name)
                with system.open_input_file(at) as raw:
                    packed = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    yield from batched(parse(io.BufferedReader(_Blocks(_inflated(raw) if packed else iter(lambda: raw.read(1 << 20), b"")), 1 << 16), name))

    return files.select("path").mapInArrow(run, SCHEMA)


def _inflated(raw) -> Iterator[bytes]:
    """The content of the members of a gzip file, as far as it can be read."""
    d = zlib.decompressobj(31)
    data = raw.read(1 << 20)
    while data:
        try:
            yield d.decompress(data, 1 << 22)
        except zlib.error:
            return
        data = d.unconsumed_tail or d.unused_data.lstrip(b"\0") if d.eof else d.unconsumed_tail
        if d.eof:
            d = zlib.decompressobj(31)
        data = data or raw.read(1 << 20)


class _Blocks(io.RawIOBase):
    """A raw stream over blocks of bytes."""

    def __init__(self, blocks: Iterator[bytes]) -> None:
        self.blocks, self.left, self.at = blocks, b"", 0

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while self.at == len(self.left):
            block = next(self.blocks, None)
            if block is None:
                return 0
            self.left, self.at = memoryview(block), 0
        n = min(len(b), len(self.left) - self.at)
        b[:n] = self.left[self.at : self.at + n]
        self.at += n
        return n


def assemble(records: DataFrame) -> DataFrame:
    """Records in SCHEMA (other columns are ignored) -> one nested row per capture.

    Columns: capture_id, target_uri, warc_date, n_records, response (record_id, warc_type, start, headers,
    payload, truncated), request (record_id, start, headers, payload), metadata (array of record_id,
    warc_type, payload, in order of record_id).

    A capture is a record of a type in CAPTURES. Another record belongs to the capture it reaches over
    concurrent-to links, in either direction and over other records; of several equally near ones to that of the
    smallest id. The request of the smallest record_id is ``request``, any further ones stand in
    ``metadata``. Records that reach no capture give a row each, with a null response. A null record_id
    stands for itself (named by file and offset); nulls in other columns stay null; links to absent records
    don't count. Records that repeat a record_id count once (the first by file and offset). Captures that
    are linked to each other stay apart. Payloads may be null, empty or of any length that a row can hold; a
    capture's row holds all the small records that belong to it. An empty table gives no rows.
    """
    columns = ["warc_type", "target_uri", "warc_date", "http_start", "http_headers", "payload", "truncated"]
    own = F.coalesce("record_id", F.concat_ws("#", F.lit("record"), "file", "offset"))
    is_capture = F.coalesce(F.col("warc_type").isin(*CAPTURES), F.lit(False))
    r = records.select(own.alias("id"), is_capture.alias("is_capture"), F.coalesce("concurrent_to", F.array().cast("array<string>")).alias("links"), "file", "offset", *columns)

    # everything but the captures' payloads, once
    light = r.withColumn("payload", F.expr("if(is_capture, null, payload)")).withColumn("http_headers", F.expr("if(is_capture, null, http_headers)"))
    light = cut(light)
    repeated = cut(light.groupBy("id").count().where("count > 1").select("id"))
    again = not repeated.isEmpty()
    first = Window.partitionBy("id").orderBy("file", "offset", "warc_type", F.xxhash64("payload"))
    if again:
        light = light.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")

    one_way = light.select("id", F.explode("links").alias("other"))
    edges = one_way.union(one_way.select("other", "id")).where("id <> other").distinct()
    reached = light.where("is_capture").select("id", F.col("id").alias("capture"))
    rest = light.where("not is_capture").select("id")
    labels = None
    todo = cut(edges.join(rest, "id", "left_semi"))  # links of records that are still without a capture
    front = reached
    while not todo.isEmpty():
        found = cut(todo.join(front.select(F.col("id").alias("other"), "capture"), "other").groupBy("id").agg(F.min("capture").alias("capture")))
        if found.isEmpty():
            break
        # a projection of its own: the constraints of a checkpoint don't survive a union as they are
        named = found.select("id", F.concat("capture", F.lit("")).alias("capture"))
        labels = named if labels is None else labels.unionByName(named)
        todo = cut(todo.join(found.select("id"), "id", "left_anti"))
        front = found

    small = light.where("not is_capture")
    small = small.join(labels, "id", "left") if labels is not None else small.withColumn("capture", F.lit(None).cast("string"))
    item = F.struct("id", "warc_type", F.col("http_start").alias("start"), F.col("http_headers").alias("headers"), "payload", "target_uri", "warc_date")
    by_id = lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    groups = small.groupBy(F.coalesce("capture", "id").alias("key"), F.col("capture").isNull().alias("orphan")).agg(F.array_sort(F.collect_list(item), by_id).alias("items"))

    captures = r.where("is_capture")
    if again:
        odd = captures.join(repeated, "id", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        captures = captures.join(repeated, "id", "left_anti").unionByName(odd)
    response = F.struct(F.col("id").alias("record_id"), "warc_type", F.col("http_start").alias("start"), F.col("http_headers").alias("headers"), "payload", "truncated")
    captures = captures.select(F.col("id").alias("capture_id"), "target_uri", "warc_date", response.alias("response"))
    joined = captures.join(groups.where("not orphan").select(F.col("key").alias("capture_id"), "items").hint("shuffle_hash"), "capture_id", "left")
    orphans = groups.where("orphan").select(
        F.col("key").alias("capture_id"), F.col("items")[0]["target_uri"].alias("target_uri"), F.col("items")[0]["warc_date"].alias("warc_date"),
        F.lit(None).cast(joined.schema["response"].dataType).alias("response"), "items",
    )
    items = F.coalesce("items", F.array().cast(joined.schema["items"].dataType))
    requests = F.filter(items, lambda x: x["warc_type"] == "request")
    request = F.try_element_at(requests, F.lit(1))
    others = F.filter(items, lambda x: F.coalesce(x["id"] != request["id"], F.lit(True)))
    return joined.unionByName(orphans).select(
        "capture_id", "target_uri", "warc_date", (F.size(items) + F.col("response").isNotNull().cast("int")).alias("n_records"), "response",
        F.when(request.isNotNull(), F.struct(request["id"].alias("record_id"), request["start"].alias("start"), request["headers"].alias("headers"), request["payload"].alias("payload"))).alias("request"),
        F.transform(others, lambda x: F.struct(x["id"].alias("record_id"), x["warc_type"].alias("warc_type"), x["payload"].alias("payload"))).alias("metadata"),
    )


def _urn(kind: str, page_id: int, url: str) -> str:
    h = hashlib.md5(f"{kind}|{page_id}|{url}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def transaction(page_id: int, url: str, html: str) -> bytes:
    """A page as a crawler's WARC records: response, request and metadata, linked in one of several usual ways."""
    ids = {kind: _urn(kind, page_id, url) for kind in ("response", "request", "metadata")}
    links = {"metadata": ids["request"] if page_id % 2 else ids["response"]}
    links |= {"response": ids["request"]} if page_id % 3 == 0 else {"request": ids["response"]}
    m = re.match(r"https?://([^/?#]*)([^#]*)", url)
    host, path = (m[1], m[2] or "/") if m else ("", "/")
    blocks = {
        "response": ("application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html.encode()),
        "request": ("application/http; msgtype=request", f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()),
        "metadata": ("application/warc-fields", f"page-id: {page_id}\r\n".encode()),
    }
    out = []
    for kind, (content, block) in blocks.items():
        link = f"WARC-Concurrent-To: {links[kind]}\r\n" if kind in links else ""
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ids[kind]}\r\n{link}WARC-Target-URI: {url}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n"
        out += head.encode(), block, b"\r\n\r\n"
    return b"".join(out)


def page_records(pages: DataFrame) -> DataFrame:
    """The records, in SCHEMA, of the WARC bytes of ``(page_id, url, html)``; pages without page_id are left out, other nulls are empty."""

    def run(batches):
        def rows():
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    yield from parse(io.BytesIO(transaction(page_id, url or "", html or "")), f"page-{page_id}")

        yield from batched(rows())

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").where("page_id is not null").mapInArrow(run, SCHEMA)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written as WARC records, read back and assembled; the nested row's fields by name."""
    a = assemble(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    info = F.col("metadata")[0]
    return a.select(
        F.regexp_extract(info["payload"].cast("string"), r"page-id: (\d+)", 1).cast("bigint").alias("page_id"), "capture_id", "target_uri", "warc_date",
        F.col("n_records").cast("bigint").alias("n_records"), F.col("request.record_id").alias("request_id"), F.col("request.start").alias("request_line"),
        F.col("request.headers")["host"][0].alias("request_host"), F.col("response.start").alias("status_line"), F.col("response.headers")["content-type"][0].alias("content_type"),
        F.col("response.payload").cast("string").alias("payload"), info["record_id"].alias("metadata_id"), F.size("metadata").cast("bigint").alias("n_metadata"),
    )


def _urn_sql(kind: str) -> str:
    h = f"md5('{kind}|' || page_id || '|' || url)"
    return f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"


ORACLE = f"""
SELECT page_id, {_urn_sql("response")} AS capture_id, url AS target_uri, '2024-01-01T00:00:00Z' AS warc_date, CAST(3 AS BIGINT) AS n_records,
  {_urn_sql("request")} AS request_id,
  'GET ' || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1), ''), '/') || ' HTTP/1.1' AS request_line,
  regexp_extract(url, '^https?://([^/?#]*)', 1) AS request_host, 'HTTP/1.1 200 OK' AS status_line, 'text/html; charset=utf-8' AS content_type,
  html AS payload, {_urn_sql("metadata")} AS metadata_id, CAST(1 AS BIGINT) AS n_metadata
FROM pages
"""
