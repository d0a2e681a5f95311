"""Lineage cuts and size-checked broadcasts that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a key-only side is broadcast; beyond it the plain (shuffled) join runs.
BROADCAST_ROWS = 1_000_000
CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a local one only where none is configured.

    Unless the session says otherwise, what lies there goes once nothing refers to it any more.
    """
    sc = spark.sparkContext
    conf = sc._jsc.sc().conf()
    if not conf.contains(CLEAN):
        conf.set(CLEAN, "true")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="chunkloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its counted ``rows`` stay within ``limit``."""
    return F.broadcast(df) if rows <= limit else df
