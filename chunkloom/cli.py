"""Command line: process, inspect, stats, validate, convert, init, formats, serve."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from pathlib import Path

from chunkloom.config import STRATEGIES, Config
from chunkloom.errors import LoomError


def _config(a: argparse.Namespace) -> Config:
    cfg = Config.load(a.config) if a.config else Config.discover() or Config()
    given = {k: v for k, v in {"strategy": a.strategy, "target_size": a.size, "min_size": a.min_size, "max_size": a.max_size, "overlap": a.overlap, "unit": a.unit}.items() if v is not None}
    return dataclasses.replace(cfg, chunking=dataclasses.replace(cfg.chunking, **given)) if given else cfg


def _chunks(spark, a: argparse.Namespace):
    from pyspark.sql import functions as F

    from chunkloom.operators import stages
    from chunkloom.sources.files import read_dataset, read_documents

    if len(a.inputs) == 1 and a.dataset:
        d = read_dataset(spark, a.inputs[0])
        return d.select("id", "content", "metadata.*", *[c for c in ("quality", "retrieval", "context_prefix") if c in d.columns])
    docs = read_documents(spark, a.inputs)
    for r in docs.where("error is not null").select("source", "error").collect():
        print(f"{r['source']}: {r['error']}", file=sys.stderr)
    return stages.run(docs.where(F.col("error").isNull()), _config(a))[0]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("chunkloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("process", "inspect", "stats", "validate", "convert"):
        s = sub.add_parser(name)
        s.add_argument("inputs", nargs="+")
        s.add_argument("--dataset", action="store_true", help="the input is a chunk dataset, not documents")
        s.add_argument("--config")
        s.add_argument("--strategy", choices=STRATEGIES)
        s.add_argument("--unit")
        for n in ("size", "min-size", "max-size", "overlap"):
            s.add_argument(f"--{n}", type=int)
        s.add_argument("--output")
        s.add_argument("--format", help="one format; without it those of the configuration")
        s.add_argument("--chunk")
        s.add_argument("--search")
        s.add_argument("--section")
        s.add_argument("--limit", type=int, default=20)
        s.add_argument("--strict", action="store_true")
    sub.add_parser("init").add_argument("path", nargs="?", default="chunkloom.json")
    sub.add_parser("formats")
    s = sub.add_parser("serve")
    s.add_argument("--jobs", default="output/jobs", help="a folder that all executors share")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8000)
    a = p.parse_args(argv)
    try:
        if a.command == "formats":
            from chunkloom.sinks.writers import available_formats
            from chunkloom.sources.parsers import supported_suffixes

            print("read:", *supported_suffixes(), "\nwrite:", *available_formats())
            return 0
        if a.command == "init":
            Path(a.path).write_text(json.dumps(Config().to_dict(), indent=2))
            return 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("chunkloom").getOrCreate()
        if a.command == "serve":
            from chunkloom.service import server

            print(f"http://{a.host}:{a.port}/")
            server(spark, a.jobs, a.host, a.port).serve_forever()
        return _run(spark, a)
    except LoomError as e:
        print(e, file=sys.stderr)
        return 2


def _run(spark, a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from chunkloom.functions import exprs as X
    from chunkloom.operators import corpus, search
    from chunkloom.sinks import writers

    chunks = _chunks(spark, a)
    if a.command == "process" and not a.format:
        cfg = _config(a)
        print(*writers.write_dataset(chunks, dataclasses.replace(cfg, output=dataclasses.replace(cfg.output, directory=a.output)) if a.output else cfg), sep="\n")
    elif a.command in ("process", "convert"):
        writers.export(chunks, a.output or "output/chunks", a.format or "jsonl")
    elif a.command == "stats":
        print(json.dumps(writers.statistics(chunks), indent=2, ensure_ascii=False, default=str))
    elif a.command == "inspect":
        found = search.find(chunks, a.chunk) if a.chunk else search.page(search.filtered(chunks, search=a.search, section=a.section), ["document_id", "chunk_index"], limit=a.limit)
        text = F.col("content") if a.chunk else X.truncate("content")
        for r in found.select("id", "section", "size", text.alias("content")).toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    else:
        c = _config(a).chunking
        issues = corpus.validate(chunks, duplicate_of="duplicate_of", least=c.min_size, most=c.max_size).cache()
        for r in corpus.issue_summary(issues).orderBy("level", "code").collect():
            print(*r)
        return int(issues.where("level = 'error'").count() > 0 or a.strict and issues.count() > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
