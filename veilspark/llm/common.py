"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_table

#: a word is a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts lineage (a lost executor never replays what is before the table) and
    fixes results that a replay could order differently.  The folder is the
    shared one the cluster names; a new one is used for every call.
    """
    return write_table(df, f"llm-{tag}")


def text_or_empty(col="text"):
    return F.coalesce(F.col(col), F.lit(""))


def shipped(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once per context.

    A cluster job normally names it in ``--py-files``; a session that was
    started without it gets the package's sources as a zip from the driver.
    """
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return spark
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="llm-code-"), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._llm_shipped = True
    return spark


def arrow_schema(ddl: str):
    """Arrow schema of a flat DDL text, for use inside Python workers."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def arrow_batch(columns, schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def rows_of(batches, rows: int = 256):
    """Rows of Arrow batches as tuples, converted a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, rows).columns))


def tidied(task):
    """A batch function that gives freed memory back when its task ends.

    Python workers are reused by later tasks; without this they keep the
    largest task's memory for good.
    """
    def run(batches):
        try:
            yield from task(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run
