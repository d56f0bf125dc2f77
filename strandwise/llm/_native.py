"""DataFrame-only helpers: A-Z lower-casing, fixed-size key filters, checkpoints."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: One row of a key filter holds this many bits.
ROW_BITS = 32768
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain lower() does that to ASCII texts, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names; on a cluster there has to be one, for executors don't share temporary ones."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strandwise-")
        spark.sparkContext.setCheckpointDir(root)  # a session refuses the setting once it runs
    return root.rstrip("/")


def saved(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint, in the shared folder that the session names; lost executors don't lose it."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return frame.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, so that later readers prune its columns.

    Its shuffle files go when it is complete, not when the driver forgets the frame.
    """
    path = shared_folder(frame.sparkSession, name)
    with settings(frame.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        frame.write.parquet(path)
    table = frame.sparkSession.read.schema(frame.schema).parquet(path)
    table.folder = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int, size: int):
    """Within it, plans hand Python workers at most so many rows and bytes at once."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), BATCH_BYTES: str(size)})


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on plans of this session hand Python workers at most so many bytes at once, unless it has a bound of its own.

    For plans that run after they are returned, so that :func:`small_batches` doesn't reach them. The JVM's buffers of a batch,
    outside its heap, and the worker's copies are as large as the batch: 10,000 rows by Spark's own setting.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(size))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Within it, the session has these settings; the caller's come back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def key_filter(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """A bitmap of hashed keys: at most ``bits / 8`` bytes, whatever the number of keys.

    It never misses a key; it lets others through as it fills up.
    """
    spot = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    return keys.select(F.bitmap_bucket_number(spot).alias("_bucket"), F.bitmap_bit_position(spot).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))


def passes(rows: DataFrame, key: Column, bitmap: DataFrame, bits: int, flag: str) -> DataFrame:
    """The rows with a column ``flag``: whether the key filter lets their key through."""
    spot = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    marked = rows.withColumn("_spot", spot).withColumn("_bucket", F.bitmap_bucket_number("_spot"))
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(bitmap_bit_position(_spot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    on = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_spot) % 8 as int))")) > 0, F.lit(False))
    return marked.join(F.broadcast(bitmap), "_bucket", "left").withColumn(flag, on).drop("_bucket", "_bitmap", "_spot")
