"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors can reach.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Where that is unset, a local session
    gets a temporary folder, and any other an error: its executors would not see the driver's folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="likegraph-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/likegraph/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"


_RECORDS = threading.local()


@contextmanager
def recorded():
    """A list of the paths that ``written`` takes inside, in this thread."""
    outer, paths = getattr(_RECORDS, "paths", None), []
    _RECORDS.paths = paths
    try:
        yield paths
    finally:
        _RECORDS.paths = outer
        if outer is not None:
            outer.extend(paths)


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, by the writer's options: cuts the lineage, and no lost executor takes it along."""
    path = new_path(df.sparkSession, what)
    if getattr(_RECORDS, "paths", None) is not None:
        _RECORDS.paths.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_paths(spark: SparkSession, paths: list[str], but: DataFrame) -> list[str]:
    """Deletes the tables at paths, except those that but reads, which are returned."""
    files = but.inputFiles()
    kept = [p for p in paths if any(f"{urlsplit(p).path}/" in f for f in files)]
    for p in paths:
        if p not in kept:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return kept


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again. A table that lies anywhere else is an error, and stays."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/likegraph/{spark.sparkContext.applicationId}")
        own = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath() + "/"
        names = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        if any(not unquote(urlsplit(name).path).startswith(own) for name in names):
            raise ValueError("not a table of written()")
        for name in names:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_all(spark: SparkSession) -> None:
    """Deletes every table and file that this application's operators have left in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/likegraph/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
