"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import workers_find_package

#: White space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` uses exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch: a bound on a worker's memory whatever the length of texts.
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers by the bytes of an Arrow batch. A lower bound that the session has stays.

    The setting stays in the session: it is read when a query runs, which is after the operator returned.
    """
    workers_find_package(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = lambda x: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(x)
    if not 0 < size(spark.conf.get(name)) < size(BATCH_BYTES):
        spark.conf.set(name, BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a temporary one, but on this machine alone, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="emberline-"))
    return sc.getCheckpointDir()


@contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted when it is done, as its rows are kept elsewhere."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Compute once and keep the rows in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    with shuffle_files_go(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """As :func:`cut`, as compressed columns; the second value deletes the rows once nothing reads them any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with shuffle_files_go(spark):
        df.write.parquet(path)

    def drop() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), drop


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def share(col, seed: int):
    """A reproducible uniform number in [0, 1) of a column."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), col), 11) * F.lit(2.0**-53)
