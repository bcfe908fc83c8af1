"""DuckDB SQL text for the oracle side of every registered query.

The oracle recomputes each result independently with plain SQL over the
same parquet views (different algorithms on purpose: split arrays and
running sums for offsets, a recursive CTE for overlap resolution, string
aggregation for masking).  Regexes use the RE2 dialect (ASCII classes).
"""

from __future__ import annotations

from ..functions.patterns import (
    MESSAGE_RULES,
    SPAN_PATTERNS,
    re2_regex,
)


#: the Unicode e-mail pattern with RE2's classes for Python's ``\\w``
UNICODE_EMAIL_RE2 = (r"[\p{L}\p{M}\p{N}\p{Pc}._%+-]+@[\p{L}\p{M}\p{N}\p{Pc}.-]+\.[\p{L}\p{M}\p{N}\p{Pc}]{2,}")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def cells_sql(table: str, key: str, columns: list[str]) -> str:
    parts = [
        f"SELECT CAST({key} AS BIGINT) AS row_index, {i} AS column_ordinal, {q(c)} AS column_name, "
        f"CAST({c} AS VARCHAR) AS cell_text FROM {table}"
        for i, c in enumerate(columns)
    ]
    body = "\nUNION ALL\n".join(parts)
    return f"SELECT * FROM ({body}) WHERE cell_text IS NOT NULL AND cell_text <> ''"


def raw_spans_sql(cells_cte: str, patterns=None) -> str:
    """All regex matches with code-point offsets, one SELECT per pattern."""
    patterns = patterns if patterns is not None else SPAN_PATTERNS
    parts = []
    for prio, (ptype, regex, flags) in enumerate(patterns):
        p = q(re2_regex(regex, flags))
        parts.append(
            f"""SELECT row_index, column_ordinal, column_name, cell_text, {prio} AS prio, {q(ptype)} AS pii_type,
  ms[k] AS text,
  CAST(coalesce(list_sum(list_transform(gs[1:k], lambda x: length(x))), 0)
     + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) AS INTEGER) AS start_pos,
  CAST(coalesce(list_sum(list_transform(gs[1:k], lambda x: length(x))), 0)
     + coalesce(list_sum(list_transform(ms[1:k], lambda x: length(x))), 0) AS INTEGER) AS end_pos
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (
  SELECT *, regexp_extract_all(cell_text, {p}) AS ms, regexp_split_to_array(cell_text, {p}) AS gs
  FROM {cells_cte} WHERE regexp_matches(cell_text, {p})))"""
        )
    return "\nUNION ALL\n".join(parts)


def kept_spans_ctes(cells_cte: str, patterns=None, prefix: str = "") -> str:
    """CTE text (without WITH) defining ``{prefix}raw``, ``{prefix}ord``,
    ``{prefix}nx`` and recursive ``{prefix}kept`` (greedy by start, prio)."""
    raw = raw_spans_sql(cells_cte, patterns)
    return f"""{prefix}raw AS ({raw}),
{prefix}ord AS (SELECT *, row_number() OVER (PARTITION BY row_index, column_ordinal ORDER BY start_pos, prio) AS rn
  FROM {prefix}raw),
{prefix}nx AS (SELECT a.*, (SELECT min(b.rn) FROM {prefix}ord b WHERE b.row_index = a.row_index
  AND b.column_ordinal = a.column_ordinal AND b.start_pos >= a.end_pos) AS nxt FROM {prefix}ord a),
{prefix}kept AS (SELECT * FROM {prefix}nx WHERE rn = 1
  UNION ALL
  SELECT n.* FROM {prefix}nx n JOIN {prefix}kept c ON n.row_index = c.row_index
    AND n.column_ordinal = c.column_ordinal AND n.rn = c.nxt)"""


def entities_sql_ctes(table: str, key: str, columns: list[str], patterns=None, window: int = 50) -> str:
    """CTEs ending in ``ent``: the entity rows of a table (kept spans)."""
    return f"""cells AS ({cells_sql(table, key, columns)}),
{kept_spans_ctes('cells', patterns)},
ent AS (SELECT row_index, column_ordinal, column_name, cell_text,
  CAST(row_number() OVER (PARTITION BY row_index, column_ordinal ORDER BY start_pos) - 1 AS INTEGER) AS span_ord,
  text, pii_type, start_pos, end_pos, 0.9::DOUBLE AS confidence,
  substring(cell_text, greatest(start_pos - {window}, 0) + 1,
            least(length(cell_text), end_pos + {window}) - greatest(start_pos - {window}, 0)) AS context,
  'regex' AS detection_method, 'regex' AS base_method, prio
  FROM kept)"""


def message_class_regex(severity: str) -> str:
    """One alternation per severity class with scoped flags (RE2)."""
    from ..functions.patterns import pattern_for

    alts = []
    for sev, ptype, _tok in MESSAGE_RULES:
        if sev == severity:
            spec = pattern_for(ptype)
            alts.append(f"(?{spec.flags}:{spec.regex})" if spec.flags else f"(?:{spec.regex})")
    return "|".join(alts)


def severity_sql(col: str, max_len: int | None = None, unicode_email: bool = False) -> str:
    gate = f" OR length({col}) > {max_len}" if max_len else ""
    last = f"WHEN regexp_matches({col}, {q(UNICODE_EMAIL_RE2)}) THEN 'sensitive' " if unicode_email else ""
    return (
        f"CASE WHEN {col} IS NULL OR {col} = ''{gate} THEN NULL "
        f"WHEN regexp_matches({col}, {q(message_class_regex('critical'))}) THEN 'critical' "
        f"WHEN regexp_matches({col}, {q(message_class_regex('sensitive'))}) THEN 'sensitive' "
        f"WHEN regexp_matches({col}, {q(message_class_regex('contextual'))}) THEN 'contextual' {last}END"
    )


def mask_message_sql(col: str) -> str:
    from ..functions.patterns import pattern_for

    expr = col
    for _sev, ptype, tok in MESSAGE_RULES:
        spec = pattern_for(ptype)
        expr = f"regexp_replace({expr}, {q(spec.re2())}, {q(tok)}, 'g')"
    return expr


def log_keys_sql(col: str) -> str:
    from ..functions.patterns import LOG_KEY_PATTERNS

    expr = col
    for regex, tok in LOG_KEY_PATTERNS:
        expr = f"regexp_replace({expr}, {q(regex)}, {q(tok)}, 'g')"
    return expr


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else f"{float(x)!r}::DOUBLE"
                                                 for x in r) + ")" for r in rows)


def base_score_sql(t: str) -> str:
    from ..functions.patterns import BASE_RISK_CRITICAL, BASE_RISK_HIGH, BASE_RISK_MEDIUM

    lst = lambda xs: ", ".join(q(x) for x in xs)
    return (f"(CASE WHEN {t} IN ({lst(BASE_RISK_CRITICAL)}) THEN 0.9::DOUBLE WHEN {t} IN ({lst(BASE_RISK_HIGH)}) "
            f"THEN 0.7::DOUBLE WHEN {t} IN ({lst(BASE_RISK_MEDIUM)}) THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END)")


def base_level_sql(t: str) -> str:
    from ..functions.patterns import BASE_RISK_CRITICAL, BASE_RISK_HIGH, BASE_RISK_MEDIUM

    lst = lambda xs: ", ".join(q(x) for x in xs)
    return (f"(CASE WHEN {t} IN ({lst(BASE_RISK_CRITICAL)}) THEN 'critical' WHEN {t} IN ({lst(BASE_RISK_HIGH)}) "
            f"THEN 'high' WHEN {t} IN ({lst(BASE_RISK_MEDIUM)}) THEN 'medium' ELSE 'low' END)")


def level_sql(score: str) -> str:
    return (f"(CASE WHEN {score} >= 0.85::DOUBLE THEN 'critical' WHEN {score} >= 0.65::DOUBLE THEN 'high' "
            f"WHEN {score} >= 0.45::DOUBLE THEN 'medium' ELSE 'low' END)")


def analyzed_sql_ctes(source: str, key: str, columns: list[str], patterns, window: int = 100) -> str:
    """CTEs ending in ``aent``: kept spans with anchor groups and risk."""
    return f"{entities_sql_ctes(source, key, columns, patterns)},\n{risk_sql_ctes(window)}"


def risk_sql_ctes(window: int = 100) -> str:
    """CTEs from ``ent`` to ``aent``: anchor groups and risk of the spans in ``ent``."""
    from ..functions.patterns import pair_risk_entries

    same = "b.row_index = a.row_index AND b.column_ordinal = a.column_ordinal"
    return f"""pr(ta, tb, score) AS ({_values(pair_risk_entries())}),
nxa AS (SELECT a.*, (SELECT min(b.span_ord) FROM ent b WHERE {same} AND b.start_pos > a.start_pos + {window})
  AS nxt_anchor FROM ent a),
anc AS (SELECT row_index, column_ordinal, span_ord, nxt_anchor FROM nxa WHERE span_ord = 0
  UNION ALL
  SELECT n.row_index, n.column_ordinal, n.span_ord, n.nxt_anchor FROM nxa n JOIN anc a
    ON n.row_index = a.row_index AND n.column_ordinal = a.column_ordinal AND n.span_ord = a.nxt_anchor),
anc2 AS (SELECT row_index, column_ordinal, span_ord AS anchor,
  CAST(row_number() OVER (PARTITION BY row_index, column_ordinal ORDER BY span_ord) - 1 AS INTEGER) AS group_ord
  FROM anc),
grp AS (SELECT e.*, (SELECT max(b.anchor) FROM anc2 b WHERE b.row_index = e.row_index
  AND b.column_ordinal = e.column_ordinal AND b.anchor <= e.span_ord) AS anchor FROM ent e),
grp2 AS (SELECT g.*, a.group_ord, count(*) OVER (PARTITION BY g.row_index, g.column_ordinal, g.anchor) AS group_size
  FROM grp g JOIN anc2 a ON a.row_index = g.row_index AND a.column_ordinal = g.column_ordinal AND a.anchor = g.anchor),
oth AS (SELECT a.row_index, a.column_ordinal, a.span_ord,
  max(coalesce(pr.score, 0.3::DOUBLE)) AS max_pair,
  list(b.pii_type || ':' || substring(b.text, 1, 20) || '...' ORDER BY b.span_ord) AS related
  FROM grp2 a JOIN grp2 b ON {same} AND b.anchor = a.anchor AND b.span_ord <> a.span_ord
  LEFT JOIN pr ON pr.ta = a.pii_type AND pr.tb = b.pii_type
  GROUP BY a.row_index, a.column_ordinal, a.span_ord),
aent0 AS (SELECT g.*, o.max_pair, o.related,
  CASE WHEN g.group_size > 1 THEN least(1.0::DOUBLE, {base_score_sql('g.pii_type')} + o.max_pair * 0.5::DOUBLE)
       ELSE {base_score_sql('g.pii_type')} END AS risk_score
  FROM grp2 g LEFT JOIN oth o ON o.row_index = g.row_index AND o.column_ordinal = g.column_ordinal
    AND o.span_ord = g.span_ord),
aent AS (SELECT row_index, column_ordinal, column_name, span_ord, text, pii_type, start_pos, end_pos, confidence,
  context, base_method,
  CASE WHEN group_size > 1 THEN 'proximity' ELSE base_method END AS detection_method,
  group_ord, CAST(group_size AS INTEGER) AS group_size, risk_score,
  CASE WHEN group_size > 1 THEN {level_sql('risk_score')} ELSE {base_level_sql('pii_type')} END AS risk_level,
  coalesce(related, []::VARCHAR[]) AS related_entities
  FROM aent0)"""
