"""What the operators share: reading tables, shared scratch tables, batching."""

from __future__ import annotations

import atexit
import functools
import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of whole texts in one Arrow batch; Spark's own default is 10,000.
ROWS_PER_BATCH = 1000


def bounded(spark: SparkSession) -> SparkSession:
    """Lower the session's Arrow batches to ROWS_PER_BATCH, unless they are smaller: rows here hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ROWS_PER_BATCH))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, local mode takes a temporary one; a cluster has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="shared-")
    return _OWN["dir"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/verdance/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM has ended: the cluster's own cleaning of that folder applies
        pass


def written(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """df as a table in the shared folder, reread: cuts lineage, and survives the loss of any executor.

    compact: rows are far smaller than the texts that they come from, so they are put together into files of the advised
    size first (not one for each task that read texts); adaptive execution sizes the parts, whatever the keys.
    """
    path = scratch_path(bounded(df.sparkSession), name)
    df = df.hint("rebalance") if compact else df
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(col: str = "text"):
    """UTF-8 bytes of a text; null counts as empty."""
    return F.encode(F.coalesce(F.col(col), F.lit("")), "utf-8")


def batch_count(df: DataFrame, col: str, batch_mb: int) -> int:
    """How many batches of about batch_mb the column makes: grows with the input, so that a batch never does."""
    total = df.select(F.sum(F.octet_length(col)).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / (batch_mb << 20)))


def small(batches, rows: int = 256):
    """Arrow batches in slices of a few rows, so that Python objects of only these exist at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def slices(numbers) -> list[tuple[int, int, int]]:
    """(number, start, end) of each run of a sorted array: only of those that occur, however many there could be."""
    import numpy as np

    if not len(numbers):
        return []
    starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    return list(zip(numbers[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(numbers)], strict=True))


def trim() -> None:
    """Give memory that is free inside this Python process back to the system: workers live on after a task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """A function of batches that trims at its end."""

    @functools.wraps(run)
    def batches(it):
        try:
            yield from run(it)
        finally:
            trim()

    return batches


def trimmed_group(run):
    """Likewise for a function of (key, table) or (key, left, right): Spark looks at how many arguments it takes."""

    def one(key, table):
        try:
            return run(key, table)
        finally:
            trim()

    def two(key, left, right):
        try:
            return run(key, left, right)
        finally:
            trim()

    return two if run.__code__.co_argcount == 3 else one


def fold(mod: int):
    """crc32 of doc_id as text, modulo mod (null ids: the empty string)."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % mod
