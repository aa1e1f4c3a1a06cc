"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is set, a local session (tests) gets its own."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="mailsift-")
    return _own_dirs[context.applicationId]


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one for one run of one job; it goes when the session ends."""
    path = f"{shared_dir(spark)}/mailsift/{purpose}-{uuid.uuid4().hex[:12]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """MLlib tree lineages are cut with RDD checkpoints, which need the context-level setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))


def at_once(spark: SparkSession, *jobs: Callable[[], Any]) -> list:
    """Results of jobs that do not depend on each other, run side by side: one's tasks fill the cores that another leaves free."""
    run = inheritable_thread_target(spark)(lambda job: job())
    with ThreadPoolExecutor(len(jobs)) as pool:
        return list(pool.map(run, jobs))


def materialise(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to shared storage and read it back: lineage ends there and survives lost executors."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def give_back() -> None:
    """Have Arrow and the C library (where it is one that can) give back freed memory that they hold for later."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def given_back(batches: Iterator) -> Iterator:
    """The batches or values that a task makes. Afterwards freed memory is given back; a worker that waits for its next task would keep it."""
    yield from batches
    give_back()


# Rows of a bucket, about.
BUCKET_ROWS = 1_000_000


def bucket_count(df: DataFrame) -> int:
    """Buckets for tables that are joined with each other: they must have equally many."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))


def bucketed(df: DataFrame, key: str, buckets: int, purpose: str) -> DataFrame:
    """Write a table dealt to buckets by its key and sorted within them, and read it back.

    The session's catalog records the bucketing, so joins and groupings by the key of tables with equally many
    buckets need no shuffle. The key is dealt once, when the table is written: one file for each bucket.
    """
    spark = df.sparkSession
    path = run_dir(spark, purpose)
    name = f"mailsift_{purpose.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    writer = df.repartition(buckets, key).write.option("path", f"{path}/table")
    writer.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    return spark.table(name)


def materialise_checked(
    df: DataFrame, path: str, violations: dict[str, Column], partition_by: list[str] | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """Write a table and count its ``rows`` and those that break a rule in what was written; any such row is an error.

    The counts read the columns of the rules alone. (Metrics observed by the write itself would save that, but the
    plans that are written here do not serialise with them.)
    """
    table = materialise(df, path, partition_by)
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in violations.items()]]
    seen = {name: int(value) for name, value in table.agg(*counts).first().asDict().items()}
    broken = {name: seen[name] for name in violations if seen[name]}
    if broken:
        raise ValueError(f"rows that break a rule in {path}: {broken}")
    return table, seen


def local_table(spark: SparkSession, rows: list, schema) -> DataFrame:
    """A table from rows the driver holds anyway; marked for broadcast, as Spark cannot see its size."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def sized(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that is expected to be small; Spark then knows its bytes and broadcasts it if they are few."""
    return materialise(df, f"{run_dir(df.sparkSession, purpose)}/table")
