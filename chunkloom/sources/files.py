"""Files as documents: discovery and parsing on the executors, a row for every file, failed ones too."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.errors import InputError
from chunkloom.functions import exprs as X
from chunkloom.sources.parsers import parse_bytes, parse_markdown, supported_suffixes

SKIPPED = r"/(\.git|\.hg|\.svn|\.venv|venv|node_modules|__pycache__|\.mypy_cache|\.pytest_cache|dist|build)/"
SCHEMA = "document_id string, title string, source string, content string, metadata map<string,string>, error string"


def read_documents(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """Documents of files and folders in SCHEMA. A path that isn't there is an error; a file that can't be parsed is a row with ``error``.

    Folders give the files of known suffixes outside build and version-control folders.
    """
    paths = [paths] if isinstance(paths, str) else paths
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).globStatus(path):
            raise InputError(f"{p} doesn't exist")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    known = "(?i)(" + "|".join(s.replace(".", r"\.") for s in supported_suffixes()) + ")$"
    files = files.select("path", "content").where(F.col("path").rlike(known) & ~F.col("path").rlike(SKIPPED)).dropDuplicates(["path"])

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    p = parse_bytes(data, path)
                    rows.append((p.title, path, p.content, list(p.metadata.items()), None))
                except Exception as e:  # one bad file stops nothing
                    rows.append((None, path, None, [], f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["title", "source", "content", "metadata", "error"])

    parsed = files.mapInArrow(run, "title string, source string, content string, metadata map<string,string>, error string")
    return parsed.select(X.document_id("source", "title", F.coalesce("content", F.lit(""))).alias("document_id"), *parsed.columns)


def from_text(spark: SparkSession, text: str, title: str = "Document", source: str = "inline") -> DataFrame:
    p = parse_markdown(text, source)
    d = spark.createDataFrame([(title, source, p.content, p.metadata, None)], "title string, source string, content string, metadata map<string,string>, error string")
    return d.select(X.document_id("source", "title", "content").alias("document_id"), *d.columns)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A chunk dataset written as JSON lines or as one JSON object of ``documents``, retrieval terms included."""
    from chunkloom.sources.tables import looks_like_dataset

    head = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 4096).alias("h")).first()
    whole = head is not None and head["h"].lstrip().startswith("{") and spark.range(1).select(looks_like_dataset(F.lit(head["h"]))).first()[0] and '"documents"' in head["h"][:40]
    rows = spark.read.option("multiLine", str(bool(whole)).lower()).json(path)
    return rows.select(F.inline("documents")) if whole else rows
