"""Helpers that several corpus operators use."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Shuffle files of a written table go when it is written, instead of at some collection of the driver's memory.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folders: dict[str, str | None] = {}  # by application, where no shared folder is set


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or a temporary one where it is unset in local mode (tests). On a cluster it must be set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = _own_folders.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="tideline-")
        _own_folders[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/tideline"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes `df` once into the shared folder and reads it back, so that lost executors cost no more than their own tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python workers in batches of `rows` and about 8 MB from here on: at the defaults of 10,000 and 64 MB, one batch of long texts takes hundreds of MB there."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def pieces(batch, column: str, most: int = 8 << 20):
    """Slices of an Arrow batch of about `most` bytes in a binary column, so that the Python objects of one slice are all that a worker holds besides the batch."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column) -> "F.Column":
    """UTF-8 bytes of a string column; null becomes empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def digests(column) -> "list[F.Column]":
    """Two 64-bit hashes of the bytes of a column, which together with an id name a row by what it says rather than by its id alone."""
    return [F.xxhash64(column), F.xxhash64(F.lit(1), column)]
