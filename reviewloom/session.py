"""Session helpers: a local session for tests and the checkpoint folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", checkpoint_dir: str | None = None
) -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own.

    ``checkpoint_dir`` is the folder for kept results; operators that keep any need one.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reviewloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir:
        spark.sparkContext.setCheckpointDir(checkpoint_dir)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable with the folder the session names; none is made up."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get(CHECKPOINT_CONF, None)
    if not shared:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    context.setCheckpointDir(shared)


ROWS_PER_PARTITION = 1_000_000


def placed_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for a kept table of narrow rows: one per ``ROWS_PER_PARTITION``, at least one per core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_PARTITION))


def grown_partitions(spark: SparkSession, rows: int, per_task: int = ROWS_PER_PARTITION) -> int:
    """Partitions for a shuffle of ``rows``: as many as the session sets, more where a task would get over ``per_task``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def run_together(spark: SparkSession, works: Iterable[Callable[[], Result]], at_once: int) -> list[Result]:
    """Results of independent pieces of work, in order.

    Each submits its own jobs; Spark fills the cores one leaves idle with the tasks
    of another. Nothing but job submission happens in the threads.
    """
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(work)) for work in works]
        return [future.result() for future in running]
