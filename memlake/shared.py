"""Tables in the folder that driver and executors share.

Iterative operators cut their lineage with them: unlike what executors keep, they survive lost executors.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}
_folders: list[str] = []
_scratch = threading.local()


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local session that has none, a temporary folder. Elsewhere executors would not see that: an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        folder = tempfile.mkdtemp(prefix="memlake-")
        _made[app] = "file://" + folder
        spark.sparkContext.setCheckpointDir(_made[app])
        atexit.register(shutil.rmtree, folder, True)
    return _made[app]


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared one."""
    folder = f"{shared_root(spark)}/memlake/{label}-{uuid.uuid4().hex}"
    _folders.append(folder)
    for made in getattr(_scratch, "made", []):
        made.append(folder)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread puts into the shared folder meanwhile is deleted at the end: for steps that leave nothing which reads it."""
    _scratch.made = [*getattr(_scratch, "made", []), []]
    try:
        yield
    finally:
        *_scratch.made, made = _scratch.made
        for folder in made:
            if folder in _folders:
                _folders.remove(folder)
                delete_folder(spark, folder)


def remove_stored(spark: SparkSession, keep: tuple[str, ...] = ()) -> int:
    """Delete what this process has put into the shared folder: to be called when no result is read any more. keep: labels that stay."""
    gone = [f for f in _folders if not f.rpartition("/")[2].startswith(tuple(f"{k}-" for k in keep))]
    for folder in gone:
        _folders.remove(folder)
        delete_folder(spark, folder)
    return len(gone)


def delete_folder(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, uri: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back."""
    uri = shared_folder(df.sparkSession, label)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def fingerprint(spark: SparkSession, uri: str) -> tuple[str, int, int]:
    """Where a table's files are, their bytes, and when the last of them was changed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [store.getFileStatus(path), *(store.listStatus(path) if store.getFileStatus(path).isDirectory() else [])]
    return store.makeQualified(path).toString(), store.getContentSummary(path).getLength(), max(f.getModificationTime() for f in files)
