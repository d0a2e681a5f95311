"""Streams of documents: the stateless stages on a Structured Streaming source, and a sink that drops repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chunkloom.config import Config
from chunkloom.functions import exprs as X
from chunkloom.operators import stages
from chunkloom.sinks import records

DOCUMENTS = "document_id string, title string, source string, content string"


def stream_chunks(documents: DataFrame, cfg: Config | None = None) -> DataFrame:
    """The chunk table of a stream of documents: kernel and per-row expressions, no state, so it never waits."""
    return stages.chunks_of(stages.process(documents, cfg), cfg)


def new_only(chunks: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Chunks whose folded text hasn't come within the watermark of column ``time``; later copies go."""
    return chunks.withColumn("content_hash", X.content_hash("content")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def stream_to_json(spark: SparkSession, source: str, target: str, checkpoint: str, cfg: Config | None = None, once: bool = False) -> StreamingQuery:
    """From a folder of JSON documents to a folder of chunk records; the checkpoint makes each file count once."""
    docs = spark.readStream.schema(DOCUMENTS).json(source)
    out = records.nested(stream_chunks(docs, cfg)).writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
