"""Masking operators: whole tables in place, and formula neutralising."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, VeilConfig
from ..functions import spans as S
from .cells import named


def mask_table(df: DataFrame, key: str, columns: list[str], cfg: VeilConfig = DEFAULT) -> DataFrame:
    """Same shape as the input; only cells holding a span change.

    The row's values are put in one array and a single masking expression
    is applied to every element with ``transform``; the values are then put
    back in their columns.  No unpivot/pivot round trip and no shuffle, and
    the detection expression exists once in the plan however wide the
    table is.
    """
    targets = [c for c in df.columns if c in columns]
    if not targets:
        return df

    from .detect import kept_spans_sql

    x = "cell_v"
    masked_one = S.mask_with_spans_sql(x, kept_spans_sql(x, cfg))
    vals = ", ".join("CAST(`{}` AS STRING)".format(c.replace("`", "``")) for c in targets)
    expr = f"transform(array({vals}), {x} -> CASE WHEN {x} IS NULL OR {x} = '' THEN {x} ELSE {masked_one} END)"
    masked = df.withColumn("__masked", F.expr(expr))
    pos = {c: i for i, c in enumerate(targets)}
    return masked.select(*[
        F.col("__masked")[pos[c]].alias(c) if c in pos else named(c) for c in df.columns
    ])


def sanitize_formula(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Strip one leading ``= + - @`` so spreadsheet tools do not evaluate a
    cell as a formula (opt-in: it also changes negative numbers)."""
    cols = columns or df.columns
    return df.select(*[
        F.regexp_replace(named(c).cast("string"), r"^[=+\-@]", "").alias(c) if c in cols else named(c)
        for c in df.columns
    ])
