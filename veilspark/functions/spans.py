"""Column expressions that find, resolve and mask PII spans inside one text.

All of it is built from Catalyst expressions (``regexp_extract_all``,
``aggregate``, ``transform``, ``substring``), so it runs inside whole-stage
codegen, needs no shuffle (everything is per cell) and works unchanged in
batch and Structured Streaming.

Offsets are 0-based, half-open and counted in code points, like Python's
``match.start()/end()``; Spark's ``length``/``substring`` count code points
too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import (
    CONTEXT_WINDOW,
    NER_CONFIDENCE,
    PatternRegistry,
    PatternSpec,
)

SPAN_FIELDS = "start INT, end INT, prio INT, text STRING, pii_type STRING, confidence DOUBLE, method STRING"
SPAN_TYPE = (
    "struct<start:INT,end:INT,prio:INT,text:STRING,pii_type:STRING,confidence:DOUBLE,method:STRING>"
)
SPAN_ARRAY_TYPE = f"array<{SPAN_TYPE}>"


# ---------------------------------------------------------------- SQL text
# The span expressions are generated as Spark SQL text and parsed once with
# ``F.expr``: the same Catalyst expressions as the DataFrame API, built
# without thousands of driver round trips.  Lambda variables get unique
# names; ``element_at(transform(array(v), b -> ...), 1)`` binds ``v`` once
# (a "let"), so an array used twice is computed once.

_counter = [0]


def _var(prefix: str) -> str:
    _counter[0] += 1
    return f"{prefix}_{_counter[0]}"


def sql_str(s: str) -> str:
    """Spark SQL string literal (backslash escapes are on by default)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_of(c) -> str:
    """SQL text of a plain column reference (or SQL text passed through)."""
    if isinstance(c, str):
        return c
    name = c._jc.toString()
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"expected a plain column reference, got {name!r}")
    return f"`{name}`"


EMPTY_SQL = f"cast(array() as {SPAN_ARRAY_TYPE})"

#: elements per block of a blocked fold
BLOCK = 512


def _blocked_fold_sql(items: str, start: str, out_type: str, step, keep: str) -> str:
    """Left fold that grows an output array without copying it per element.

    ``items`` is a bound array, ``start`` the fields of the first state,
    ``step(state, item)`` gives ``(fields of the next state, condition,
    element)`` and ``keep`` names the state fields carried between blocks.
    An item that fails the condition changes nothing.  A fourth part of the
    step says when the element is appended, if not with every change of state.
    Elements are appended to a block's own array and blocks are concatenated,
    so n elements cost about n * (BLOCK + n / BLOCK) copies instead of n * n.
    """
    outer, inner, i, k, done = _var("o"), _var("s"), _var("i"), _var("k"), _var("d")
    fields, condition, element, *appended = step(inner, f"{items}[{i}]")
    empty = f"cast(array() as {out_type})"
    carry = ", ".join(f"'{f}', {outer}.{f}" for f in keep.split())
    back = ", ".join(f"'{f}', {done}.{f}" for f in keep.split())
    grown = f"array_append({inner}.out, {element})"
    if appended:
        grown = f"CASE WHEN {appended[0]} THEN {grown} ELSE {inner}.out END"
    body = f"named_struct({fields}, 'out', {grown})"
    if condition:
        body = f"CASE WHEN {condition} THEN {body} ELSE {inner} END"
    block = (f"aggregate(sequence({k}, least({k} + {BLOCK}, size({items})) - 1), "
             f"named_struct({carry}, 'out', {empty}), ({inner}, {i}) -> {body}, "
             f"{done} -> named_struct({back}, 'out', concat({outer}.out, {done}.out)))")
    return (f"CASE WHEN size({items}) = 0 THEN named_struct({start}, 'out', {empty}) ELSE "
            f"aggregate(sequence(0, size({items}) - 1, {BLOCK}), named_struct({start}, 'out', {empty}), "
            f"({outer}, {k}) -> {block}) END")


def _let_sql(value: str, body) -> str:
    v = _var("v")
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def _guard_sql(t: str, spec: PatternSpec, unicode: bool) -> str | None:
    if spec.guard is None:
        return None
    kind, value = spec.guard
    if kind == "contains":
        return f"contains({t}, {sql_str(value)})"
    flags = ("U" if unicode else "") + spec.flags
    return f"({t} RLIKE {sql_str((f'(?{flags})' if flags else '') + value)})"


def pattern_spans_sql(t: str, spec: PatternSpec, prio: int, unicode: bool = True) -> str:
    # the text between matches comes from splitting by the same pattern, so
    # groups and back-references of a user's pattern keep their numbers
    g, mm = _var("g"), _var("mm")
    pattern = sql_str(spec.java(unicode))

    def fold(pairs: str) -> str:
        def step(acc: str, x: str):
            start = f"{acc}.pos + length({x}.g)"
            span = (f"named_struct('start', {start}, 'end', {start} + length({x}.m), 'prio', {int(prio)}, "
                    f"'text', {x}.m, 'pii_type', {sql_str(spec.pii_type)}, 'confidence', {float(spec.confidence)!r}D, "
                    f"'method', {sql_str(spec.method)})")
            return f"'pos', {start} + length({x}.m)", None, span

        return "(" + _blocked_fold_sql(pairs, "'pos', 0", SPAN_ARRAY_TYPE, step, "pos") + ").out"

    def found(m: str) -> str:
        pairs = (f"zip_with(slice(split({t}, {pattern}, -1), 1, size({m})), {m}, "
                 f"({g}, {mm}) -> named_struct('g', {g}, 'm', {mm}))")
        return f"CASE WHEN size({m}) = 0 THEN {EMPTY_SQL} ELSE {_let_sql(pairs, fold)} END"

    body = _let_sql(f"regexp_extract_all({t}, {pattern}, 0)", found)
    guard = _guard_sql(t, spec, unicode)
    return body if guard is None else f"CASE WHEN {guard} THEN {body} ELSE {EMPTY_SQL} END"


def registry_spans_sql(t: str, registry: PatternRegistry, unicode: bool = True) -> str:
    parts = [pattern_spans_sql(t, spec, i, unicode) for i, spec in enumerate(registry)]
    if not parts:
        return EMPTY_SQL
    return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"


def _by_start_sql() -> str:
    a, b = _var("a"), _var("b")
    return f"({a}, {b}) -> CASE WHEN {a}.start < {b}.start THEN -1 WHEN {a}.start > {b}.start THEN 1 ELSE 0 END"


def _by_start_prio_sql() -> str:
    """Order of overlap resolution: start, then registry priority (the
    struct's own field order would break start ties by end)."""
    a, b = _var("a"), _var("b")
    return (f"({a}, {b}) -> CASE WHEN {a}.start < {b}.start THEN -1 WHEN {a}.start > {b}.start THEN 1 "
            f"WHEN {a}.prio < {b}.prio THEN -1 WHEN {a}.prio > {b}.prio THEN 1 ELSE 0 END")


def resolve_overlaps_sql(spans: str, mixed_confidence: bool = False) -> str:
    if not mixed_confidence:
        def step(acc: str, x: str):
            return (f"'last_end', greatest({acc}.last_end, {x}.end)", f"{x}.start >= {acc}.last_end", x)

        return _let_sql(f"array_sort({spans}, {_by_start_prio_sql()})", lambda v: "(" + _blocked_fold_sql(
            v, "'last_end', 0", SPAN_ARRAY_TYPE, step, "last_end") + ").out")

    # Sorted by start, a span can only overlap the kept span that reaches
    # furthest, and kept spans never overlap each other: one open span is all
    # that has to be carried.  A span behind it closes it (and is open next), a
    # more confident one replaces it, any other is dropped.
    def sweep(acc: str, x: str):
        behind = f"({acc}.open IS NULL OR {x}.start >= {acc}.open.end)"
        return (f"'open', {x}", f"({behind} OR {x}.confidence > {acc}.open.confidence)", f"{acc}.open",
                f"{acc}.open IS NOT NULL AND {behind}")

    def swept(v: str) -> str:
        folded = _blocked_fold_sql(v, f"'open', CAST(NULL AS {SPAN_TYPE})", SPAN_ARRAY_TYPE, sweep, "open")
        last = _var("x")
        return _let_sql(folded, lambda r: f"concat({r}.out, filter(array({r}.open), {last} -> {last} IS NOT NULL))")

    return _let_sql(f"array_sort({spans}, {_by_start_prio_sql()})", swept)


def mask_with_spans_sql(t: str, spans: str) -> str:
    """Kept spans do not overlap: the text is cut once, left to right, into the
    pieces between them (slices of its characters) and joined again."""
    def masked(both: str) -> str:
        def step(acc: str, x: str):
            piece = (f"concat(array_join(slice({both}.c, {acc}.pos + 1, {x}.start - {acc}.pos), ''), "
                     f"'[', upper({x}.pii_type), '_REDACTED]')")
            return f"'pos', {x}.end", None, piece

        folded = _blocked_fold_sql(f"{both}.s", "'pos', 0", "array<string>", step, "pos")
        return _let_sql(folded, lambda r: f"concat(array_join({r}.out, ''), array_join(slice({both}.c, {r}.pos + 1, "
                                          f"greatest(size({both}.c) - {r}.pos, 0)), ''))")

    # one let for the spans decides whether the text is cut at all
    return _let_sql(f"array_sort({spans}, {_by_start_sql()})", lambda v: (
        f"CASE WHEN size({v}) = 0 THEN {t} ELSE "
        + _let_sql(f"named_struct('s', {v}, 'c', split({t}, ''))", masked) + " END"))


# ---------------------------------------------------------------- Column API


def guard_expr(text: Column, spec: PatternSpec, unicode: bool = True) -> Column | None:
    """Cheap necessary condition of ``spec`` as a Column (None when it has none)."""
    if spec.guard is None:
        return None
    kind, value = spec.guard
    if kind == "contains":
        return text.contains(value)
    flags = ("U" if unicode else "") + spec.flags
    return text.rlike((f"(?{flags})" if flags else "") + value)


def pattern_spans(text, spec: PatternSpec, prio: int, unicode: bool = True) -> Column:
    """All non-overlapping matches of one pattern as an array of span structs."""
    return F.expr(pattern_spans_sql(sql_of(text), spec, prio, unicode))


def registry_spans(text, registry: PatternRegistry, unicode: bool = True) -> Column:
    """Concatenated raw spans of every registry pattern (before overlap resolution)."""
    return F.expr(registry_spans_sql(sql_of(text), registry, unicode))


def resolve_overlaps(spans, mixed_confidence: bool = False) -> Column:
    """Greedy overlap resolution over spans sorted by (start, prio).

    Equal confidence never replaces, so with one confidence level the rule is
    simply "keep a span if it starts at or after the end of the last kept
    span".  With mixed confidence (regex 0.9 next to model spans 0.8) the
    general rule applies: a span that overlaps kept spans is compared with the
    first of them only, replaces it when strictly more confident, and
    otherwise is dropped.  ``spans`` is SQL text or a column reference.
    """
    return F.expr(resolve_overlaps_sql(sql_of(spans), mixed_confidence))


def mask_with_spans(text, spans) -> Column:
    """Replace every (non-overlapping) span with ``[<TYPE>_REDACTED]``."""
    return F.expr(mask_with_spans_sql(sql_of(text), sql_of(spans)))


def context_snippet(text: Column, start: Column, end: Column, window: int = CONTEXT_WINDOW) -> Column:
    """``text[max(0, start-w) : min(len, end+w)]``."""
    lo = F.greatest(start - window, F.lit(0))
    hi = F.least(F.length(text), end + window)
    return F.substring(text, lo + 1, hi - lo)


def preview(text: Column, n: int) -> Column:
    """First ``n`` characters plus ``...`` only when the text is longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def ner_spans_from_array(items: Column, prio_base: int) -> Column:
    """Turn an array<struct<start,end,text,pii_type>> from a model or
    gazetteer detector into span structs that rank after all regex spans."""
    return F.transform(
        items,
        lambda x: F.struct(
            x["start"].cast("int").alias("start"),
            x["end"].cast("int").alias("end"),
            F.lit(prio_base).alias("prio"),
            x["text"].alias("text"),
            x["pii_type"].alias("pii_type"),
            F.lit(NER_CONFIDENCE).alias("confidence"),
            F.lit("ner").alias("method"),
        ),
    )
