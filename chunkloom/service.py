"""Jobs as written tables, and their HTTP face.

A job is a folder of the shared job folder: ``chunks`` and ``documents`` as Parquet, and a row of the ``jobs``
table. Whatever is asked about a job is a query over its tables, so any session that sees the folder can
answer, and nothing is held in memory. The server is the standard library's; it hands requests on.
"""

from __future__ import annotations

import email.parser
import email.policy
import json
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom import __version__
from chunkloom.config import STRATEGIES, UNITS, Chunking, Cleaning, Config, Context, Deduplication, Semantics
from chunkloom.errors import ConfigError, InputError, LoomError
from chunkloom.functions import exprs as X
from chunkloom.operators import corpus, search, stages
from chunkloom.sinks import records, writers
from chunkloom.sources.files import from_text
from chunkloom.sources.parsers import parse_bytes, supported_suffixes

MOST_BYTES = 64 << 20  #: of an upload
_JOB = "job_id string, status string, created_at double, title string, source string, error string"
_TYPES = {"jsonl": "application/x-ndjson", "json": "application/json", "csv": "text/csv", "markdown": "text/markdown"}


class NotFound(InputError):
    """No such job or path."""


def options(given: dict) -> Config:
    """The configuration of a request's options; unknown ones are errors."""
    yes = lambda k, default: str(given.get(k, default)).lower() in ("1", "true", "yes", "on")
    known = {"strategy", "target_size", "min_size", "max_size", "overlap", "unit", "clean", "deduplicate", "context_prefix", "separate_retrieval_metadata"}
    if odd := sorted(set(given) - known):
        raise ConfigError(f"unknown options {', '.join(odd)}", hint=", ".join(sorted(known)))
    try:
        sizes = {k: (float if k == "overlap" else int)(given[k]) for k in ("target_size", "min_size", "max_size", "overlap") if k in given}
    except (TypeError, ValueError) as e:
        raise ConfigError(str(e)) from e
    names = {k: given[k] for k in ("strategy", "unit") if k in given}
    return Config(
        chunking=Chunking(**sizes, **names), cleaning=Cleaning(enabled=yes("clean", True)), deduplication=Deduplication(enabled=yes("deduplicate", True)),
        context=Context(add_prefix=yes("context_prefix", True)), semantics=Semantics(enabled=yes("separate_retrieval_metadata", True)),
    )


class Jobs:
    """The jobs of a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _rows(self) -> DataFrame:
        """One row a job, the last written of it."""
        try:
            found = self.spark.read.schema(_JOB + ", written double").json(f"{self.folder}/jobs")
        except Exception as e:  # no job yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = self.spark.createDataFrame([], _JOB + ", written double")
        names = [c.split()[0] for c in _JOB.split(", ")]
        last = found.groupBy("job_id").agg(F.max_by(F.struct(*names), "written").alias("j")).select("j.*")
        return last.where("status <> 'deleted'")

    def _note(self, job: dict) -> dict:
        writers.write_text(self.spark, f"{self.folder}/jobs/{job['job_id']}-{uuid.uuid4().hex[:8]}.json", json.dumps(job | {"written": time.time()}))
        return job

    def list(self) -> DataFrame:
        """All jobs, the newest first."""
        return self._rows().orderBy(F.desc("created_at"), "job_id")

    def get(self, job_id: str) -> dict:
        found = self._rows().where(F.col("job_id") == job_id).first()
        if found is None:
            raise NotFound(f"no job {job_id}")
        return found.asDict()

    def delete(self, job_id: str) -> None:
        job = self.get(job_id)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{job_id}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._note(job | {"status": "deleted"})

    def process(self, documents: DataFrame, cfg: Config, title: str, source: str) -> dict:
        """Runs the stages and writes the tables; a failure is a job too."""
        job = {"job_id": uuid.uuid4().hex[:12], "status": "running", "created_at": time.time(), "title": title, "source": source, "error": None}
        self._note(job)
        try:
            chunks, processed = stages.run(documents, cfg)
            chunks.write.parquet(f"{self.folder}/{job['job_id']}/chunks")
            processed.write.parquet(f"{self.folder}/{job['job_id']}/documents")
        except Exception as e:
            self._note(job | {"status": "failed", "error": str(e)[:2000]})
            raise
        return self._note(job | {"status": "completed"})

    def process_text(self, text: str, cfg: Config, title: str = "Document", source: str = "inline") -> dict:
        return self.process(from_text(self.spark, text, title, source), cfg, title, source)

    def process_bytes(self, data: bytes, name: str, cfg: Config) -> dict:
        if len(data) > MOST_BYTES:
            raise InputError(f"{name} has more than {MOST_BYTES >> 20} MB")
        p = parse_bytes(data, name)
        d = self.spark.createDataFrame([(p.title, name, p.content)], "title string, source string, content string")
        return self.process(d.select(X.document_id("source", "title", "content").alias("document_id"), "*"), cfg, p.title, name)

    def chunks(self, job_id: str) -> DataFrame:
        self.get(job_id)
        return self.spark.read.parquet(f"{self.folder}/{job_id}/chunks")

    def page(self, job_id: str, offset: int = 0, limit: int = 50, **filters) -> dict:
        flat = self.chunks(job_id).withColumn("flags", F.coalesce("quality.flags", F.array().cast("array<string>")) if "quality" in self.chunks(job_id).columns else F.array().cast("array<string>"))
        found = search.filtered(flat, **filters)
        rows = search.page(found, ["document_id", "chunk_index"], offset, limit)
        return {"job_id": job_id, "total": found.count(), "offset": offset, "limit": limit, "chunks": _rows(records.nested(rows))}

    def statistics(self, job_id: str) -> dict:
        return writers.statistics(self.chunks(job_id))

    def validate(self, job_id: str) -> dict:
        c = self.chunks(job_id)
        issues = _rows(corpus.validate(c, duplicate_of="duplicate_of"))
        return {"ok": all(i["level"] != "error" for i in issues), "checked": c.count(), "errors": [i for i in issues if i["level"] == "error"], "warnings": [i for i in issues if i["level"] == "warning"], "coverage": self.coverage(job_id)}

    def coverage(self, job_id: str) -> dict:
        processed = self.spark.read.parquet(f"{self.folder}/{job_id}/documents")
        return corpus.coverage_summary(stages.audit(processed, self.chunks(job_id))).first().asDict()

    def previews(self, job_id: str) -> list[dict]:
        processed = self.spark.read.parquet(f"{self.folder}/{job_id}/documents").select(F.col("document_id").alias("id"), "title", "source", "content")
        chunks = self.chunks(job_id).withColumnRenamed("id", "_chunk").withColumnRenamed("document_id", "id")
        return _rows(search.previews(processed, chunks, "id", "_chunk"))

    def export(self, job_id: str, fmt: str = "jsonl") -> str:
        """The path of the written export."""
        path = f"{self.folder}/{job_id}/export-{fmt}-{uuid.uuid4().hex[:8]}"
        writers.export(self.chunks(job_id), path, fmt)
        return path


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


class _Handler(BaseHTTPRequestHandler):
    jobs: Jobs

    def _send(self, status: int, body, kind: str = "application/json") -> None:
        data = body if isinstance(body, bytes) else json.dumps(body, ensure_ascii=False, default=str).encode()
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def _answer(self, handle) -> None:
        try:
            self._send(*handle())
        except NotFound as e:
            self._send(404, {"detail": str(e)})
        except LoomError as e:
            self._send(400, {"detail": str(e)})
        except Exception as e:  # a request never ends the server
            self._send(500, {"detail": f"{type(e).__name__}: {e}"})

    def do_GET(self) -> None:
        self._answer(self._get)

    def do_POST(self) -> None:
        self._answer(self._post)

    def do_DELETE(self) -> None:
        def handle():
            parts = self._path()[0]
            if len(parts) != 2 or parts[0] != "jobs":
                raise NotFound(self.path)
            self.jobs.delete(parts[1])
            return 200, {"status": "deleted", "job_id": parts[1]}

        self._answer(handle)

    def _path(self) -> tuple[list[str], dict[str, str]]:
        u = urlsplit(self.path)
        return [unquote(p) for p in u.path.split("/") if p], dict(parse_qsl(u.query))

    def _get(self):
        parts, query = self._path()
        jobs = self.jobs
        match parts:
            case ["health"]:
                return 200, {"status": "ok", "version": __version__, "jobs": jobs.list().count()}
            case ["formats"]:
                return 200, {"input_formats": supported_suffixes(), "output_formats": writers.available_formats(), "strategies": list(STRATEGIES), "units": list(UNITS)}
            case ["jobs"]:
                return 200, _rows(jobs.list())
            case ["jobs", job]:
                return 200, jobs.get(job)
            case ["jobs", job, "chunks"]:
                plain = {k: query[k] for k in ("search", "section", "content_type", "role") if query.get(k)}
                flags = {k: query[k].lower() in ("1", "true", "yes") for k in ("knowledge_only", "flagged") if k in query}
                return 200, jobs.page(job, int(query.get("offset", 0)), int(query.get("limit", 50)), **plain, **flags)
            case ["jobs", job, "statistics"]:
                return 200, jobs.statistics(job)
            case ["jobs", job, "validate"]:
                return 200, jobs.validate(job)
            case ["jobs", job, "preview"]:
                return 200, {"job_id": job, "documents": jobs.previews(job)}
            case ["jobs", job, "export"]:
                fmt = query.get("format", "jsonl")
                path = jobs.export(job, fmt)
                text = jobs.spark.read.text(path, wholetext=True) if fmt != "parquet" else None
                if text is None:
                    return 200, {"path": path}
                return 200, "".join(r[0] for r in text.collect()).encode(), _TYPES.get(fmt, "application/octet-stream")
        raise NotFound(self.path)

    def _post(self):
        parts, query = self._path()
        size = int(self.headers.get("Content-Length", 0))
        if size > MOST_BYTES + (1 << 20):
            return 413, {"detail": "too large"}
        body = self.rfile.read(size)
        if parts == ["process", "text"]:
            try:
                asked = json.loads(body)
                text = asked["text"]
            except (ValueError, KeyError, TypeError) as e:
                raise InputError(f"a JSON object with text is needed: {e}") from e
            return 200, self.jobs.process_text(text, options(asked.get("options") or {}), asked.get("title", "Document"), asked.get("source", "inline"))
        if parts == ["process"]:
            kind = self.headers.get("Content-Type", "")
            given, name, data = dict(query), query.get("filename", "document.txt"), body
            if kind.startswith("multipart/form-data"):
                message = email.parser.BytesParser(policy=email.policy.HTTP).parsebytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + body)
                for part in message.iter_parts():
                    field = part.get_param("name", header="content-disposition")
                    if field == "file":
                        name, data = part.get_filename() or name, part.get_payload(decode=True)
                    else:
                        given[field] = part.get_payload(decode=True).decode()
            given.pop("filename", None)
            return 200, self.jobs.process_bytes(data, name, options(given))
        raise NotFound(self.path)

    def log_message(self, *args) -> None:
        pass


def server(spark: SparkSession, folder: str, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""
    return ThreadingHTTPServer((host, port), type("Handler", (_Handler,), {"jobs": Jobs(spark, folder)}))
