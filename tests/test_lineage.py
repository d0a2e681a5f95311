"""Spent checkpoints go."""

import gc
import os
import time
from urllib.parse import urlsplit

from chunkloom.plans.lineage import checkpoint_dir, cut


def _files(folder):
    return sum(len(f) for _, _, f in os.walk(folder))


def test_checkpoints_are_deleted_when_nothing_refers_to_them(spark):
    folder = urlsplit(checkpoint_dir(spark)).path
    kept = cut(spark.range(10))
    before = _files(folder)
    gone = cut(spark.range(1000))
    assert _files(folder) > before
    del gone
    for _ in range(20):
        gc.collect()
        spark._jvm.System.gc()
        if _files(folder) <= before:
            break
        time.sleep(0.5)
    assert _files(folder) <= before and kept.count() == 10
