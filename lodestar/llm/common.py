"""What the operators share: staged tables in the cluster's shared folder, and words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker gets at once while a table is staged.
BATCH_ROWS = 512
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words of the query contracts: maximal runs of anything but ASCII white space. ``bytes.split()`` gives the same.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Its characters.
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd", batch_rows: int = BATCH_ROWS, alone: bool = False) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: lineage ends here, and an executor's loss costs nothing.
    Python workers get batch_rows rows at a time meanwhile, as the default number of whole texts fills memory.
    alone: nothing else uses df, so the files of its shuffles go at once and not when the driver collects its garbage."""
    spark = df.sparkSession
    path, before, kept = new_path(spark, name), spark.conf.get(_BATCH_ROWS), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_BATCH_ROWS, str(min(int(before) if int(before) > 0 else batch_rows, batch_rows)))
    spark.conf.set(_CLEANUP, "true" if alone else kept)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_BATCH_ROWS, before)
        spark.conf.set(_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path), path


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task, and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """run, a function from batches to batches, with release() behind the last one."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return released


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing lazy reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def text_bytes(df: DataFrame, column: str = "text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def slices(batch, rows: int = 256, size: int = 2 << 20):
    """A batch of texts in parts of at most so many rows and about so many bytes (one text at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, to size partitions by."""
    return df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0
