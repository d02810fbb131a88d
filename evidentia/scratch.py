"""Intermediate tables in the folder that the cluster shares: written, read again, and removed when the program ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex
_used: dict[str, SparkSession] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this program's own in spark.checkpoint.dir.  Where that is unset: a temporary one if all runs on this machine, as in
    tests; else an error, as executors would write where others can't read."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base}/scratch-{_RUN}"
    _used[folder] = spark
    return folder


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as a table and read again: its lineage ends there, and a lost executor costs nothing that was written."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[made] = path
    return made


def discard(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more, as those of an iteration's past rounds.  Other DataFrames are left alone."""
    for df in tables:
        if df is not None and (path := _paths.pop(df, None)):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _sweep() -> None:
    for folder, spark in _used.items():
        with contextlib.suppress(Exception):  # the program is at its end; the cluster may be gone
            _delete(spark, folder)
