"""What the operators of this subpackage have in common."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from likegraph.stored import drop_all, drop_written, new_path, shared_dir, written
from likegraph.workers import let_workers_import

__all__ = ["beside", "drop_all", "drop_written", "new_path", "shared_dir", "table", "text_slices", "written"]


def text_slices(texts: pa.Array, most_bytes: int = 4_000_000):
    """(from, to, texts) over a column of texts, each run of at most most_bytes or one text; only one run is made into Python strings at a time. Nulls become empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
        yield start, stop, [t or "" for t in texts.slice(start, stop - start).to_pylist()]
        start, done = stop, int(ends[stop - 1])


def beside(kept: list[str], added: list[str]) -> list[str]:
    """Names for kept columns beside added ones: one that clashes (whatever its case) gets underscores in front."""
    taken, out = {n.lower() for n in added}, []
    for name in kept:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
