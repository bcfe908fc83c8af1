"""Risk scoring expressions (base risk, pair risk, proximity groups).

The lookup tables are a few dozen constant entries, so they are inlined as
map literals: no join, no broadcast, and the expressions stay in codegen.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import (
    BASE_RISK_CRITICAL,
    BASE_RISK_HIGH,
    BASE_RISK_MEDIUM,
    CLUSTER_LEVEL_SCORE,
    DEFAULT_PAIR_RISK,
    PROXIMITY_PAIR_FACTOR,
    RELATED_LEN,
    RISK_THRESHOLDS,
    pair_risk_entries,
    semantic_entries,
)


def _map(entries) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in entries))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("|"), b)


def pair_risk(a: Column, b: Column) -> Column:
    """Pair risk from the symmetric matrix, default 0.3."""
    m = _map((f"{x}|{y}", s) for x, y, s in pair_risk_entries())
    return F.coalesce(F.element_at(m, pair_key(a, b)), F.lit(DEFAULT_PAIR_RISK))


def semantic_weight(a: Column, b: Column) -> Column:
    """Semantic edge weight for an unordered type pair, null if unrelated."""
    m = _map((f"{x}|{y}", w) for x, y, w in semantic_entries())
    return F.element_at(m, pair_key(F.least(a, b), F.greatest(a, b)))


def base_risk_level(t: Column) -> Column:
    return (
        F.when(t.isin(*BASE_RISK_CRITICAL), F.lit("critical"))
        .when(t.isin(*BASE_RISK_HIGH), F.lit("high"))
        .when(t.isin(*BASE_RISK_MEDIUM), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def base_risk_score(t: Column) -> Column:
    return (
        F.when(t.isin(*BASE_RISK_CRITICAL), F.lit(0.9))
        .when(t.isin(*BASE_RISK_HIGH), F.lit(0.7))
        .when(t.isin(*BASE_RISK_MEDIUM), F.lit(0.5))
        .otherwise(F.lit(0.3))
    )


def score_to_level(score: Column) -> Column:
    expr = None
    for level, thr in RISK_THRESHOLDS:
        expr = F.when(score >= thr, F.lit(level)) if expr is None else expr.when(score >= thr, F.lit(level))
    return expr.otherwise(F.lit("low"))


def combined_risk(base: Column, max_pair: Column) -> Column:
    return F.least(F.lit(1.0), base + max_pair * F.lit(PROXIMITY_PAIR_FACTOR))


def level_score(level: Column) -> Column:
    """Cluster scoring of a risk level (0.25 / 0.5 / 0.75 / 1.0)."""
    return F.element_at(_map(CLUSTER_LEVEL_SCORE), level)


def anchor_groups(spans, window: int) -> Column:
    """Split spans sorted by start into anchor groups.

    The first span not yet grouped is an anchor and takes every later span
    that starts within ``window`` characters of *the anchor* (no chaining).
    With spans sorted by start this is one left-to-right pass that opens a
    new group when ``start - anchor_start > window``; the pass is linear in the
    spans.  Result:
    ``array<struct<anchor:int, members:array<span>>>``.  A group can only
    hold spans starting inside one window, so its size is bounded.
    ``spans`` is a column reference (SQL text is generated and parsed once).
    """
    from .spans import _blocked_fold_sql, _let_sql, _var, sql_of

    sp = sql_of(spans)
    s_, i, g, k, j = _var("s"), _var("i"), _var("g"), _var("k"), _var("j")

    # the fold only finds where groups begin; members are read by position
    def step(state: str, x: str):
        return (f"'anchor', {x}.start", f"({state}.anchor IS NULL OR {x}.start - {state}.anchor > {int(window)})",
                f"named_struct('anchor', {x}.start, 'first', {x}.at)")

    starts = f"transform({sp}, ({s_}, {i}) -> named_struct('start', {s_}.start, 'at', {i}))"
    begins = _let_sql(starts, lambda v: "(" + _blocked_fold_sql(
        v, "'anchor', CAST(NULL AS INT)", "array<struct<anchor:INT,first:INT>>", step, "anchor") + ").out")
    return F.expr(_let_sql(begins, lambda b: (
        f"transform({b}, ({g}, {k}) -> named_struct('anchor', {g}.anchor, 'members', transform(sequence({g}.first, "
        f"coalesce(get({b}, {k} + 1).first, size({sp})) - 1), {j} -> {sp}[{j}])))")))


def related_label(t: Column, text: Column) -> Column:
    """``<type>:<first 20 chars>...`` (the ellipsis is always added)."""
    return F.concat(t, F.lit(":"), F.substring(text, 1, RELATED_LEN), F.lit("..."))
