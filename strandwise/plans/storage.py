"""Saved and stage tables in the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where driver and executors are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strandwise-")
        spark.sparkContext.setCheckpointDir(root)  # a session refuses the setting once it runs
    return root.rstrip("/")


#: Folders of tables saved within each open :func:`scratch`.
_SCRATCH: list[list[str]] = []
#: While a table is made: shuffle files go when it is complete, and a task reads few of them, so that tasks fit a small heap.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}
#: Bytes of a Parquet row group, which each task holds on the heap until it is full.
_GROUP_BYTES = 8 << 20


def saved(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: later stages don't recompute it, and lost executors don't lose it.

    Its size is that of its files.  (A checkpoint keeps the estimate of the plan
    that made it; joined in rounds these multiply to numbers of thousands of
    digits.)  Shuffle files go when the table is complete.
    """
    spark = frame.sparkSession
    path = new_folder(spark, "saved")
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        frame.write.option("parquet.block.size", _GROUP_BYTES).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table.folder = path
    return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables saved within it are deleted at its end, but for those that are handed to what it yields."""
    own: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        own.remove(table.folder)
        if len(_SCRATCH) > 1:
            _SCRATCH[-2].append(table.folder)
        return table

    _SCRATCH.append(own)
    try:
        yield keep
    finally:
        _SCRATCH.pop()
        for folder in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(frame: DataFrame, folder: str | None, name: str) -> DataFrame:
    """Reads the named stage from ``folder`` if it is complete there, else computes and writes it."""
    if folder is None:
        return saved(frame)
    spark = frame.sparkSession
    path = f"{folder.rstrip('/')}/{name}"
    if not _complete(spark, path):
        frame.write.mode("overwrite").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _complete(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
