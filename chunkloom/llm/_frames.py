"""Column hygiene shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chunkloom.llm._text import CHUNK_CHARS

TASKS = 1 << 16  #: partitions at most of a shuffle by shard


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of about CHUNK_CHARS characters with their texts, nulls kept."""
    for batch in batches:
        texts, at, size = batch.column(batch.schema.get_field_index(column)).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= CHUNK_CHARS or i + 1 == len(texts):
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def replacing(df: DataFrame, column: str, kernel: Callable[[list[str | None]], list[str | None]]) -> DataFrame:
    """``df`` with ``column`` rewritten by ``kernel``; every other column passes through as it is."""

    def run(batches):
        for part, texts in slices(batches, column):
            i = part.schema.get_field_index(column)
            yield part.set_column(i, part.schema.field(i), pa.array(kernel(texts), part.schema.field(i).type))

    return df.mapInArrow(run, StructType(df.schema.fields))


def by_shard(df: DataFrame, shard: str, shards: int) -> GroupedData:
    """The groups of ``shard``, numbers below ``shards``: each a partition of its own, several in turn beyond TASKS shards.

    A hash of the shard would put two or three into one partition by chance, and none into others.
    """
    (task,), tasks = free(df, "task"), max(1, min(shards, TASKS))
    return df.withColumn(task, F.pmod(shard, F.lit(tasks)).cast("int")).repartitionById(tasks, task).groupBy(task, shard)
