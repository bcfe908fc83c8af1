"""Span detection over cells or message columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, VeilConfig
from ..functions import spans as S
from ..functions.patterns import PatternRegistry

ENTITY_COLUMNS = [
    "row_index", "column_ordinal", "column_name", "span_ord", "text", "pii_type",
    "start_pos", "end_pos", "confidence", "context", "detection_method", "prio",
]


def bind_column(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add ``expr`` as column ``name`` so that it is evaluated exactly once.

    Catalyst pushes a filter on a projected column below the projection by
    inlining the column's expression (and infers such a filter, ``size(x) >
    0``, for every ``explode(x)``).  For the span arrays that would run the
    whole detection twice per cell.  Producing the column from a one-element
    ``inline_outer`` generator stops that: filters on a generator's output
    stay above it, and outer generators get no inferred filters.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(expr.alias(name)))))


def raw_spans(text, cfg: VeilConfig = DEFAULT, registry: PatternRegistry | None = None) -> Column:
    return S.registry_spans(text, registry or cfg.registry, cfg.unicode_regex)


def kept_spans_sql(text: str, cfg: VeilConfig = DEFAULT, registry: PatternRegistry | None = None,
                   extra: str | None = None) -> str:
    """SQL text of the kept spans of ``text`` (SQL text)."""
    reg = registry or cfg.registry
    raw = S.registry_spans_sql(text, reg, cfg.unicode_regex)
    mixed = extra is not None or len({s.confidence for s in reg}) > 1
    if extra is not None:
        raw = f"concat({raw}, {extra})"
    return S.resolve_overlaps_sql(raw, mixed_confidence=mixed)


def kept_spans(text, cfg: VeilConfig = DEFAULT, registry: PatternRegistry | None = None,
               extra=None) -> Column:
    """Raw regex spans (plus optional model/gazetteer spans, given as a
    column reference) after overlap resolution.  Mixed confidence switches
    to the general rule."""
    ex = None if extra is None else S.sql_of(extra)
    return F.expr(kept_spans_sql(S.sql_of(text), cfg, registry, ex))


def cell_spans(cells: DataFrame, cfg: VeilConfig = DEFAULT, registry: PatternRegistry | None = None,
               resolve: bool = True, extra: Column | None = None) -> DataFrame:
    """Add a ``spans`` array column (kept spans unless ``resolve=False``)."""
    text = F.col("cell_text")
    if resolve:
        col = kept_spans(text, cfg, registry, extra)
    else:
        raw = S.registry_spans_sql(S.sql_of(text), registry or cfg.registry, cfg.unicode_regex)
        col = F.expr(f"array_sort({raw}, {S._by_start_prio_sql()})")
    return bind_column(cells.drop("spans"), "spans", col)


def explode_entities(with_spans: DataFrame, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """One row per span with context snippet (``posexplode`` keeps span order)."""
    keep = [c for c in with_spans.columns if c not in ("spans",)]
    exploded = with_spans.select(*keep, F.posexplode("spans").alias("span_ord", "s"))
    return exploded.select(
        *[c for c in keep if c != "cell_text"],
        "span_ord",
        F.col("s.text").alias("text"),
        F.col("s.pii_type").alias("pii_type"),
        F.col("s.start").alias("start_pos"),
        F.col("s.end").alias("end_pos"),
        F.col("s.confidence").alias("confidence"),
        S.context_snippet(F.col("cell_text"), F.col("s.start"), F.col("s.end"), cfg.context_window).alias("context"),
        F.col("s.method").alias("detection_method"),
        F.col("s.prio").alias("prio"),
    )


def entities(cells: DataFrame, cfg: VeilConfig = DEFAULT, registry: PatternRegistry | None = None,
             resolve: bool = True, extra: Column | None = None) -> DataFrame:
    """Cells -> entity rows (``row_index, column_ordinal, column_name,
    span_ord, text, pii_type, start_pos, end_pos, confidence, context,
    detection_method, prio``).  Narrow: no shuffle anywhere."""
    return explode_entities(cell_spans(cells, cfg, registry, resolve, extra), cfg)


# --------------------------------------------------------------------------
# Pluggable span detectors.  A detector is any function
#     cells DataFrame (row_index, column_ordinal, ..., cell_text)
#       -> spans DataFrame (row_index, column_ordinal, start, end, text, pii_type)
# e.g. the gazetteer, or a model wrapped in ``mapInPandas``.  Its spans join
# the regex spans in overlap resolution as 0.8-confidence ``ner`` spans.
# --------------------------------------------------------------------------


def attach_spans(cells: DataFrame, spans: DataFrame, prio_base: int) -> DataFrame:
    """Add an ``extra`` column holding each cell's detector spans (group by
    the cell key, left join back)."""
    per_cell = spans.groupBy("row_index", "column_ordinal").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "text", "pii_type"))).alias("g")
    )
    joined = cells.join(per_cell, ["row_index", "column_ordinal"], "left")
    empty = F.expr("cast(array() as array<struct<start:int,end:int,text:string,pii_type:string>>)")
    return joined.withColumn("extra", S.ner_spans_from_array(F.coalesce(F.col("g"), empty), prio_base)).drop("g")


def entities_with_detectors(cells: DataFrame, detectors, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """Regex registry plus any number of span detectors, resolved together."""
    spans = None
    for det in detectors:
        d = det(cells).select("row_index", "column_ordinal", F.col("start").cast("int").alias("start"),
                              F.col("end").cast("int").alias("end"), "text", "pii_type")
        spans = d if spans is None else spans.unionByName(d)
    if spans is None:
        return entities(cells, cfg)
    with_extra = attach_spans(cells, spans, prio_base=len(cfg.registry))
    return explode_entities(cell_spans(with_extra, cfg, extra=F.col("extra")).drop("extra"), cfg)
