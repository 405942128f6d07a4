"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "tidewatch") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    cpus = str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEWATCH_DRIVER_MEMORY", "12g"))
        .config("spark.checkpoint.dir", os.path.join(os.getcwd(), "spark-warehouse", "_scratch"))
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """Calendar buckets are UTC, so the session must be too."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or else one in the warehouse,
    which executors share too."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


class _Made:
    """Scratch paths of the jobs that are running, and how many those are."""

    lock = threading.Lock()
    paths: list[str] = []
    jobs = 0


@contextmanager
def scratch_of_job(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables made inside when the last job that is running ends.

    For jobs whose results are written elsewhere when they end.
    """
    with _Made.lock:
        _Made.jobs += 1
    try:
        yield
    finally:
        with _Made.lock:
            _Made.jobs -= 1
            done = [] if _Made.jobs else _Made.paths[:]
            if done:
                _Made.paths.clear()
        for path in done:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _Made.lock:
        if _Made.jobs:
            _Made.paths.append(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written once as a table in the shared folder and read back.

    That cuts the lineage: a lost executor recomputes nothing and never changes the rows. Unlike a
    checkpoint of rows it runs the plan once, compresses by column and reads only what is used.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether `df` has at most `max_rows` rows; reads no more than that plus one."""
    return df.limit(max_rows + 1).count() <= max_rows

