"""Sinks: masked tables, entity and report JSON, graph tables.

Outputs are written by the executors (``DataFrameWriter``); nothing is
gathered on the driver.  Paths should be on the shared file system.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.cells import named


def write_masked_csv(masked: DataFrame, path: str, drop: tuple[str, ...] = ("row_index",)) -> None:
    """Masked table as CSV with a header and no index column; quotes are doubled and
    blanks kept, so the reader gets back what was written."""
    masked.select(*[named(c) for c in masked.columns if c not in drop]).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, compression: str | None = None) -> None:
    w = df.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    w.json(path)


def write_json_by(df: DataFrame, column: str, path: str) -> None:
    """All rows as JSON, a folder for each value of ``column``.  Rows stay in the
    task that has them (no shuffle), so a frequent value is many files, not one task."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def write_tables(tables: dict[str, DataFrame], base: str, fmt: str = "parquet") -> dict[str, str]:
    out = {}
    for name, df in tables.items():
        path = f"{base.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(path)
        out[name] = path
    return out
