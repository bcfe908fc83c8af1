"""Spark session helpers.

Cluster settings (checkpoint folder, shuffle partitions, AQE) are read from
the session the caller built; defaults are only filled in where a setting is
unset, which is what tests and local runs need.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "veilspark") -> SparkSession:
    """Build (or reuse) a local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("VEIL_DRIVER_MEMORY", "16g"))
    )
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster this must be a shared file system path and is set by the
    operator.  Only when it is unset (local tests) a scratch folder is made.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="veil-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: tables written since the innermost ``scratch`` block began, if there is one
_written: ContextVar[list[str] | None] = ContextVar("veil_written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """A block at whose end, also after an error, the tables that ``write_table`` wrote
    inside it are deleted from the shared folder.

    Frames of this library are lazy and read such tables: whatever is to last
    must be written inside the block.  Only tables of the block's own thread
    are known; a nested block deletes its own."""
    paths: list[str] = []
    outer = _written.set(paths)
    try:
        yield paths
    finally:
        _written.reset(outer)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new folder below ``spark.checkpoint.dir`` and read it back.

    The shuffle files of the write are deleted when it ends; Spark's own cleaner waits until
    the driver happens to collect its garbage, the later the larger the tasks are.  The table
    stays until the ``scratch`` block that it is written in ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (known := _written.get()) is not None:
        known.append(path)  # before the write: a failed one leaves files too
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage of iterative jobs without keeping anything on one
    executor; unlike ``checkpoint()`` the plan runs once.  The table stays
    until the ``scratch`` block that it is written in ends.
    """
    return write_table(df, f"veil-{tag}")
