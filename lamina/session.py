"""Settings the engine reads from the session it is handed."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How stored tables are written: hashes, ids and texts take about half the room they take under Spark's own default.
#: The lowest level takes the least time; on bronze and silver tables its files are no larger than those of the default.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables, under the shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only where it is
    unset, and Spark runs on this machine alone, is a temporary folder used.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to a work folder and read back, so that what comes before is never computed again."""
    path = work_dir(df.sparkSession, purpose)
    df.write.options(**PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file, unpacked as its name asks for; None for an empty one.  No more than its head is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(conf).open(file)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
        plain = stream if codec is None else codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside it, what an action shuffled is deleted when the action ends, not once the driver happens to collect its garbage.

    For jobs that store what they compute and run no frame twice; a frame that is would be shuffled again.
    """
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the engine's own, if it is there, on whatever file system the path names."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
