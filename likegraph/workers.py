"""Python workers and this package."""

from __future__ import annotations

import ctypes
import os
from pathlib import Path

from pyspark.sql import SparkSession


#: Workers live on from stage to stage; with these, what one stage has freed goes back to the system before the next.
MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "8388608"}

#: Rows hold whole texts, so Arrow batches and column batches of the default sizes would take hundreds of MB on either side: setting, default, ours.
ROWS = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.parquet.columnarReaderBatchSize", "4096", "1000"))


def give_back() -> None:
    """Returns what this process has freed to the system, where its C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trimmed(run):
    """run (batches to batches), whose worker gives back its memory at the end of each task: it lives on, idle, beside the JVM's next stages."""

    def each(batches):
        yield from run(batches)
        give_back()

    return each


def let_workers_import(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it (on a cluster: an installed or shipped copy).

    Also sets what bounds their memory, where the session has left it at the default.
    """
    for name, default, ours in ROWS:
        if spark.conf.get(name) == default:
            spark.conf.set(name, ours)
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env.update({k: v for k, v in MEMORY.items() if k not in env})
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
