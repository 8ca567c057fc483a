"""Lineage cuts for loops: a written table in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_kept_clean: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local folder only for a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="chronoplex-")
    return _local_dirs[app]


def scratch_folder(spark: SparkSession) -> str:
    """The application's own folder in there; Spark removes it when the application ends."""
    app = spark.sparkContext.applicationId
    folder = f"{scratch_root(spark)}/{app}"
    if app not in _kept_clean:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)  # only a folder that is there can be marked
        files.deleteOnExit(path)
        _kept_clean.add(app)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once and go on from the written table.

    Unlike cached blocks the table outlives lost executors, its plan is one scan, and its size
    is known to the optimizer.
    """
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
