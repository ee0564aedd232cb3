"""Session construction and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallymart", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split hot keys also where a join is followed by work on the same key
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.ui.enabled": "false",
        # plans here have many columns: do not record the call site of each one
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    settings.update({k.replace("_", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in `spark.checkpoint.dir`. Only a local master may fall back to a temporary
    folder, because there every task runs on the driver's machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="tallymart-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_scopes: list[str] = []


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, also after an error, what was staged inside it."""
    _scopes.append(f"{staging_root(spark)}/scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, _scopes.pop())


def staging_root(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared scratch area and read it back.

    This cuts the lineage, survives the loss of any executor, and gives every later reader the same rows
    with column pruning. It runs one job when called.
    """
    spark = df.sparkSession
    root = _scopes[-1] if _scopes else staging_root(spark)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application."""
    _delete(spark, staging_root(spark))


def local_parallelism(spark: SparkSession) -> int:
    """Partition count for small frames whose rows are expensive to compute."""
    return max(1, spark.sparkContext.defaultParallelism)


def in_parallel(spark: SparkSession, fn: Callable, jobs: Iterable, workers: int) -> list:
    """Results of `fn` on each of `jobs`, in their order, run as concurrent Spark jobs.

    Each job gets a copy of the caller's local properties: a shared one would let jobs overwrite each other's
    execution ids.
    """
    with ThreadPoolExecutor(workers) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(fn), job) for job in jobs]
        return [s.result() for s in started]
