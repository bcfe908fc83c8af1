"""Table -> cells: one row per non-empty (row, column) value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def named(column: str):
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def string_columns(df: DataFrame, key: str) -> list[str]:
    return [f.name for f in df.schema.fields if f.name != key]


def to_cells(df: DataFrame, key: str = "row_index", columns: list[str] | None = None) -> DataFrame:
    """Unpivot ``columns`` into ``row_index, column_ordinal, column_name, cell_text``.

    Every value is read as a string; null and empty cells are skipped.  The
    column ordinal keeps the table's column order for entity ordering.  This
    is a narrow per-row ``inline`` (no shuffle); the key column supplies the
    row index, so no global numbering is needed.
    """
    cols = columns if columns is not None else string_columns(df, key)
    structs = [
        F.struct(
            F.lit(i).alias("column_ordinal"),
            F.lit(c).alias("column_name"),
            named(c).cast("string").alias("cell_text"),
        )
        for i, c in enumerate(cols)
    ]
    return (
        df.select(named(key).cast("long").alias("row_index"), F.inline(F.array(*structs)))
        .where(F.col("cell_text").isNotNull() & (F.col("cell_text") != ""))
    )


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0-based position of each row in the frame's partition order (what
    ``zipWithIndex`` gives), without a global sort and without Python rows.

    Rows are counted per partition (one small row per partition), a prefix
    sum over those counts gives each partition's offset, and a row's index is
    its partition offset plus its position inside the partition.  The offsets
    are written first, so the join knows their size and broadcasts them unless
    there are very many partitions; the table's rows are not shuffled then.  The input
    is evaluated twice, so it must be deterministic (a file scan is; persist
    or checkpoint anything else first).  For CSV files use
    ``sources.csv.with_file_row_index``, which orders by file position.
    """
    from pyspark.sql import Window

    tagged = df.select("*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().alias("__mid"))
    parts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__mid0"))
    # one row per partition: a bounded table, so an unpartitioned window is fine
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(parts.select("__pid", "__mid0", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off")), "offsets")
    out = tagged.join(offsets, "__pid")
    return out.select((F.col("__off") + F.col("__mid") - F.col("__mid0")).alias(name),
                      *[named(c) for c in df.columns])
