"""Exporters by name: JSON lines, one JSON object, CSV, Markdown; statistics."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.config import Config, Project
from chunkloom.errors import ExportError
from chunkloom.operators import corpus
from chunkloom.sinks import records

Exporter = Callable[[DataFrame, str, str], None]
_EXPORTERS: dict[str, Exporter] = {}


def register_exporter(name: str, exporter: Exporter) -> None:
    _EXPORTERS[name] = exporter


def available_formats() -> list[str]:
    return sorted(_EXPORTERS)


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def export(chunks: DataFrame, path: str, fmt: str = "jsonl", overwrite: bool = True, pretty: bool = False) -> None:
    """Writes the chunks in order of document and position; what exists is only replaced with ``overwrite``. ``pretty`` indents the JSON object."""
    if fmt not in _EXPORTERS:
        raise ExportError(f"unknown format {fmt}", hint=f"formats: {', '.join(available_formats())}")
    if not overwrite and "://" not in path and Path(path).exists():
        raise ExportError(f"{path} exists", hint="pass overwrite")
    ordered = chunks.orderBy("document_id", "chunk_index")
    if fmt == "json":
        _json(ordered, path, _mode(overwrite), pretty)
    else:
        _EXPORTERS[fmt](ordered, path, _mode(overwrite))


def _json(chunks: DataFrame, path: str, mode: str, pretty: bool = False) -> None:
    """One object; streamed through the driver row by row, for datasets that one file may hold."""
    if Path(path).exists() and mode != "overwrite":
        raise ExportError(f"{path} exists")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"documents": [')
        for i, r in enumerate(records.nested(chunks).select(F.to_json(F.struct("*")).alias("r")).toLocalIterator()):
            f.write((",\n" if i else "\n") + (json.dumps(json.loads(r["r"]), indent=2, ensure_ascii=False) if pretty else r["r"]))
        f.write("\n]}\n")


register_exporter("jsonl", lambda c, p, m: records.nested(c).write.mode(m).json(p))
register_exporter("json", _json)
register_exporter("csv", lambda c, p, m: records.flat(c).write.mode(m).option("header", True).option("quoteAll", True).option("escape", '"').csv(p))
register_exporter("markdown", lambda c, p, m: records.report(c).select("value").write.mode(m).text(p))
register_exporter("parquet", lambda c, p, m: c.write.mode(m).parquet(p))


def statistics(chunks: DataFrame) -> dict:
    """Sizes, histogram, breakdowns and flags of a chunk table, for statistics.json."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    return {
        "sizes": corpus.size_statistics(chunks, "size").first().asDict(), "histogram": rows(corpus.histogram(chunks, "size")),
        "by_document": rows(corpus.breakdown(chunks, F.coalesce(F.nullif("title", F.lit("")), "document_id"), "(none)", 1000)),
        **{f"by_{c}": rows(corpus.breakdown(chunks, F.col(c), "(no section)" if c == "section" else "(none)", 1000)) for c in ("section", "content_type", "semantic_role")},
        "flags": rows(corpus.flag_counts(chunks, "quality.flags").orderBy("flag")) if "quality" in chunks.columns else [],
        "kinds": corpus.knowledge_counts(chunks).first().asDict(),
        "duplicates": chunks.where("duplicate_of is not null").count() if "duplicate_of" in chunks.columns else 0,
    }


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, to any file system that the session knows."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_statistics(chunks: DataFrame, path: str, project: Project | None = None) -> None:
    found = statistics(chunks) | ({"project": dataclasses.asdict(project)} if project else {})
    write_text(chunks.sparkSession, path, json.dumps(found, indent=2, ensure_ascii=False, default=str))


def write_dataset(chunks: DataFrame, cfg: Config) -> list[str]:
    """The chunks in every format of ``cfg.output`` under its directory, and statistics.json; the paths written."""
    o = cfg.output
    made = []
    kept = chunks if o.include_quality else chunks.drop("quality")
    for fmt in o.formats:
        made.append(f"{o.directory}/{fmt}")
        export(kept, made[-1], fmt, o.overwrite, o.pretty)
    if o.statistics:
        made.append(f"{o.directory}/statistics.json")
        write_statistics(chunks, made[-1], cfg.project)
    return made
