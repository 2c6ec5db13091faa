"""The folder that the driver and the executors share, tables written there, and settings."""

from __future__ import annotations

import atexit
import shutil
import uuid
import weakref

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def setting(spark: SparkSession, name: str, default: str) -> str:
    """What the session says for spark.fathomline.<name>, else the default."""
    return spark.conf.get(f"spark.fathomline.{name}", default)


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Only a local master, as in tests, may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "/tmp/checkpoints").rstrip("/") + "/fathomline"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise gave and that nothing reads any more: the rounds of a loop."""
    for table in tables:
        path = _path_of.pop(table, None)
        if path is not None:
            _delete(table.sparkSession.sparkContext, path)
            _written.remove(path)


def file_stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and time of the last change of a file or folder, on any file system."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(there).getLength(), files.getFileStatus(there).getModificationTime()


def _delete(context: SparkContext, path: str) -> None:
    there = context._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(context._jsc.hadoopConfiguration()).delete(there, True)


@atexit.register
def _sweep() -> None:
    context = SparkContext._active_spark_context
    for path in _written:
        if context is not None and context._jsc is not None:
            _delete(context, path)
        elif (local := path.removeprefix("file://")).startswith("/"):
            shutil.rmtree(local, ignore_errors=True)
