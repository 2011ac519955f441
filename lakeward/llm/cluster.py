"""Shared-folder tables and small session helpers for the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FEW_ROWS = 2_000
GIVE_BACK = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``, or a local one where it is unset and Spark runs locally (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not configured:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lakeward-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


class Workspace:
    """Tables written once into the shared folder, so that later jobs survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
        """Write `df` and read it; with about `rows` rows known, into no more files than have `FEW_ROWS` each."""
        path = f"{self.root}/{name}"
        df = df if rows is None else df.coalesce(max(1, -(-rows // FEW_ROWS)))
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Delete all tables, once nothing reads them any more."""
        self.drop("")

    def release(self) -> None:
        """Let the driver's cleaner remove shuffle files of plans that are no longer referenced."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def parts_for(df: DataFrame, each: int) -> int:
    """Partitions for rows of `df`: the session's number, or more where its inputs have more than `each` bytes apiece."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 62 else 0  # unknown sizes are given as the largest number
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // each))


_held = 0


def resident() -> int:
    """Bytes of memory of this process, or 0 where that can't be read."""
    try:
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:
        return 0


def give_back() -> None:
    """Return what this process has freed to the system, if it holds much more than after the last time."""
    global _held
    if resident() - _held >= GIVE_BACK:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
        _held = resident()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for tasks that give back freed memory: workers stay for later stages, beside the executor's heap."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
