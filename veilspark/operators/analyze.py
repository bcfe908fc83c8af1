"""Per-cell analysis: kept spans -> proximity groups -> risk -> entity rows.

Everything happens inside one cell's span array, so the whole pipeline is a
chain of narrow projections: no shuffle, no pair explosion.  Proximity is
measured within a cell (offsets are cell-relative, so comparing offsets of
different cells would relate unrelated text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, VeilConfig
from ..functions import risk as R
from ..functions import spans as S
from ..functions.patterns import PatternRegistry
from .detect import bind_column, kept_spans

ANALYZED_COLUMNS = [
    "row_index", "column_ordinal", "column_name", "span_ord", "text", "pii_type", "start_pos", "end_pos",
    "confidence", "context", "base_method", "detection_method", "group_ord", "group_size", "risk_score",
    "risk_level", "related_entities",
]


def span_frame(cells: DataFrame, cfg: VeilConfig = DEFAULT, registry: PatternRegistry | None = None,
               extra: Column | None = None) -> DataFrame:
    """Cells plus ``spans``: kept spans sorted by start, numbered by ``ord``.
    Cells without a span are dropped here (they add nothing downstream)."""
    spans = kept_spans(F.col("cell_text"), cfg, registry, extra)
    numbered = F.transform(spans, lambda s, i: s.withField("ord", i))
    # bound once (see detect.bind_column), so the filter cannot re-run detection
    return bind_column(cells, "spans", numbered).where(F.size("spans") > 0)


def analyze_cells(cells: DataFrame, cfg: VeilConfig = DEFAULT, registry: PatternRegistry | None = None,
                  extra: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Cells (``row_index, column_ordinal, column_name, cell_text`` plus any
    ``keep`` columns) -> one row per kept span with proximity risk."""
    return entities_from_spans(span_frame(cells, cfg, registry, extra), cfg, keep)


#: a longer text is cut into blocks, so that a snippet costs no scan from the text's start
SNIPPET_TEXT, SNIPPET_BLOCK = 4096, 1024


def _with_context(framed: DataFrame, keep: list[str], window: int) -> DataFrame:
    """Spans with their ``context`` snippet; the text itself goes no further,
    so a cell with many spans doesn't copy its text for each of them."""
    cut = F.expr(f"named_struct('blocks', CASE WHEN length(cell_text) <= {SNIPPET_TEXT} THEN array(cell_text) ELSE "
                 f"regexp_extract_all(cell_text, '(?s).{{1,{SNIPPET_BLOCK}}}', 0) END, 'length', length(cell_text), "
                 f"'size', CASE WHEN length(cell_text) <= {SNIPPET_TEXT} THEN {SNIPPET_TEXT} ELSE {SNIPPET_BLOCK} END)")
    begin, stop = f"greatest(s.start - {window}, 0)", f"least(cut.length, s.end + {window})"
    first, last = f"CAST({begin} div cut.size AS INT)", f"CAST(greatest({begin}, {stop} - 1) div cut.size AS INT)"
    context = (f"substring(array_join(transform(sequence({first}, {last}), b -> cut.blocks[b]), ''), "
               f"{begin} - {first} * cut.size + 1, {stop} - {begin})")
    kept = ", ".join(f"'{f}', s.{f}" for f in ("start", "end", "prio", "text", "pii_type", "confidence", "method", "ord"))
    bound = bind_column(framed.select(*keep, "row_index", "column_ordinal", "column_name", "cell_text", "spans"), "cut", cut)
    return bind_column(bound, "found", F.expr(f"transform(spans, s -> named_struct({kept}, 'context', {context}))")).select(
        *keep, "row_index", "column_ordinal", "column_name", F.col("found").alias("spans"))


def skeleton(framed: DataFrame) -> DataFrame:
    """The span frame without texts: positions, types and order of each cell's
    spans, which is all that risk and the graph's structure depend on."""
    spans = F.expr("transform(spans, s -> named_struct('start', s.start, 'ord', s.ord, 'pii_type', s.pii_type))")
    return framed.select("row_index", "column_ordinal", "column_name", spans.alias("spans"))


def _scored(framed: DataFrame, cfg: VeilConfig, keep: list[str]) -> DataFrame:
    """One row per span ``s`` with its group and risk; ``others`` are the rest of its group."""
    # groups bound once: the filter Spark infers for the explode stays above
    with_groups = bind_column(framed, "groups", R.anchor_groups(F.col("spans"), cfg.proximity_window))
    grouped = with_groups.select(
        *keep, "row_index", "column_ordinal", "column_name",
        F.posexplode("groups").alias("group_ord", "g"),
    )
    members = grouped.select(
        *keep, "row_index", "column_ordinal", "column_name", "group_ord",
        F.col("g.members").alias("members"), F.explode("g.members").alias("s"),
    )
    s = F.col("s")
    group_size = F.size("members")
    others = F.filter(F.col("members"), lambda o: o["ord"] != s["ord"])
    max_pair = F.aggregate(others, F.lit(0.0), lambda acc, o: F.greatest(acc, R.pair_risk(s["pii_type"], o["pii_type"])))
    base = R.base_risk_score(s["pii_type"])
    score = F.when(group_size > 1, R.combined_risk(base, max_pair)).otherwise(base)
    level = F.when(group_size > 1, R.score_to_level(score)).otherwise(R.base_risk_level(s["pii_type"]))
    return members.select(*keep, "row_index", "column_ordinal", "column_name", "group_ord", "s", others.alias("others"),
                          group_size.alias("group_size"), score.alias("risk_score"), level.alias("risk_level"))


def risk_rows(framed: DataFrame, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """Type and risk of every span of a frame or a :func:`skeleton`, without texts."""
    return _scored(framed.select("row_index", "column_ordinal", "column_name", "spans"), cfg, []).select(
        "row_index", "column_ordinal", "column_name", F.col("s.ord").alias("span_ord"),
        F.col("s.pii_type").alias("pii_type"), "risk_score", "risk_level")


def entities_from_spans(framed: DataFrame, cfg: VeilConfig = DEFAULT, keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    scored = _scored(_with_context(framed, keep, cfg.context_window), cfg, keep)
    s = F.col("s")
    grouped_flag = F.col("group_size") > 1
    return scored.select(
        *keep,
        "row_index", "column_ordinal", "column_name",
        s["ord"].alias("span_ord"),
        s["text"].alias("text"),
        s["pii_type"].alias("pii_type"),
        s["start"].alias("start_pos"),
        s["end"].alias("end_pos"),
        s["confidence"].alias("confidence"),
        s["context"].alias("context"),
        s["method"].alias("base_method"),
        F.when(grouped_flag, F.lit("proximity")).otherwise(s["method"]).alias("detection_method"),
        "group_ord", "group_size", "risk_score", "risk_level",
        F.when(grouped_flag, F.transform("others", lambda o: R.related_label(o["pii_type"], o["text"])))
        .otherwise(F.array().cast("array<string>"))
        .alias("related_entities"),
    )


def near_pairs_sql(spans: str, window: int) -> str:
    """SQL text of the pairs ``i < j`` of a cell's kept spans whose starts are
    at most ``window`` apart, as structs.

    Spans are sorted by start and don't overlap, so a span's partners are the
    next ones up to a last, at most ``window`` further on, which is found by
    halving steps: the work is linear in spans and pairs."""
    steps = []
    while sum(steps) < window:
        steps.insert(0, 1 << len(steps))
    reach = (f"aggregate(array({', '.join(map(str, steps))}), i, (far, step) -> CASE WHEN far + step < size({spans}) "
             f"AND {spans}[far + step].start - {spans}[i].start <= {window} THEN far + step ELSE far END)")
    pair = (f"named_struct('src_ord', {spans}[i].ord, 'dst_ord', {spans}[j].ord, 'src_type', {spans}[i].pii_type, "
            f"'dst_type', {spans}[j].pii_type, 'distance', {spans}[j].start - {spans}[i].start)")
    of_one = S._let_sql(reach, lambda far: f"transform(slice(sequence(i, {far}), 2, {far} - i), j -> {pair})")
    found = f"flatten(transform(sequence(0, size({spans}) - 1), i -> {of_one}))"
    none = "cast(array() as array<struct<src_ord:INT,dst_ord:INT,src_type:STRING,dst_type:STRING,distance:INT>>)"
    return f"CASE WHEN size({spans}) < 2 THEN {none} ELSE {found} END" if window > 0 else none


def proximity_pairs(framed: DataFrame, cfg: VeilConfig = DEFAULT, window: int | None = None) -> DataFrame:
    """Pairs of kept spans in one cell whose starts are at most ``window``
    apart (``i < j`` in span order); the search runs inside the cell's sorted
    array (no join, no shuffle).  ``framed`` comes from :func:`span_frame`."""
    w = window if window is not None else cfg.graph_window
    pairs = bind_column(framed.select("row_index", "column_ordinal", "column_name", "spans"), "pairs",
                        F.expr(near_pairs_sql("spans", int(w))))
    return pairs.select("row_index", "column_ordinal", "column_name", F.inline("pairs"))


def group_pairs(framed: DataFrame, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """All pairs ``i < j`` inside each proximity group, with their pair risk.

    This is the pairwise view of the group analysis.  A group only holds
    spans starting within one window of its anchor, so the pairs per group
    are bounded and are built inside the cell's array (no join)."""
    bound = bind_column(framed.select("row_index", "column_ordinal", "column_name", "spans"), "groups",
                        R.anchor_groups(F.col("spans"), cfg.proximity_window))
    groups = bound.select("row_index", "column_ordinal", "column_name",
                          F.posexplode("groups").alias("group_ord", "g"))

    def partners(members):
        return lambda a: F.transform(
            F.filter(members, lambda b: b["ord"] > a["ord"]),
            lambda b: F.struct(a["ord"].alias("src_ord"), b["ord"].alias("dst_ord"),
                               a["pii_type"].alias("src_type"), b["pii_type"].alias("dst_type"),
                               R.pair_risk(a["pii_type"], b["pii_type"]).alias("pair_risk")))

    m = F.col("g.members")
    return groups.where(F.size(m) > 1).select(
        "row_index", "column_ordinal", "column_name", "group_ord",
        F.inline(F.flatten(F.transform(m, partners(m)))))
