"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame that
reads whole tables.  Column names match the oracle's aliases exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import message as M
from ..functions import spans as S
from ..functions.patterns import (
    CUSTOM_PATTERNS,
    NER_LABELS,
    NODE_TEXT_LEN,
    PREVIEW_LEN,
    SPAN_PATTERNS,
    PatternRegistry,
    pattern_for,
)
from ..operators import analyze as A
from ..operators import detect as D
from ..operators.mask import mask_table, sanitize_formula
from ..session import materialize
from ..sources.tables import spread, table
from . import sqlgen as Q
from .datasets import CHANNELS, DOCS, PAGES, PEOPLE, Dataset

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def _docs(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


SEV = Q.severity_sql("text")
MASKED = Q.mask_message_sql("text")

# ---------------------------------------------------------------- messages


@register("message_severity", f"SELECT doc_id, {SEV} AS severity FROM documents")
def message_severity(spark, sf):
    return _docs(spark, sf).select("doc_id", M.severity(F.col("text")).alias("severity"))


@register("has_pii_filter", f"SELECT doc_id, length(text) AS n_chars FROM documents WHERE ({SEV}) IS NOT NULL")
def has_pii_filter(spark, sf):
    d = _docs(spark, sf)
    return d.where(M.has_pii(F.col("text"))).select("doc_id", F.length("text").alias("n_chars"))


@register(
    "oversize_gate",
    f"SELECT doc_id, length(text) AS n_chars, {Q.severity_sql('text', 10000)} AS severity_gated, "
    f"{SEV} AS severity_scanned, "
    f"CASE WHEN length(text) > 10000 THEN 'critical' ELSE {SEV} END AS severity_blocking "
    f"FROM documents",
)
def oversize_gate(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id", F.length(t).alias("n_chars"),
        M.severity(t, oversize="clean").alias("severity_gated"),
        M.severity(t, oversize="scan").alias("severity_scanned"),
        M.severity(t, oversize="block").alias("severity_blocking"),
    )


@register("mask_message", f"SELECT doc_id, {MASKED} AS masked FROM documents")
def mask_message(spark, sf):
    return _docs(spark, sf).select("doc_id", M.mask_message(F.col("text")).alias("masked"))


def _policy_sql(policy: str) -> str:
    if policy == "log_as_is":
        out = "'[WARNING: PII DETECTED] ' || text"
        lvl = "'WARNING'"
    elif policy == "mask_and_log":
        out = f"CASE WHEN sev = 'critical' THEN '[BLOCKED] Message contained critical PII' ELSE {MASKED} END"
        lvl = "'INFO'"
    else:
        out = "'[BLOCKED] Message contained ' || sev || ' PII'"
        lvl = "'INFO'"
    return (
        f"SELECT doc_id, sev AS severity, "
        f"CASE WHEN text IS NULL OR text = '' THEN NULL WHEN sev IS NULL THEN text ELSE {out} END AS output, "
        f"CASE WHEN text IS NULL OR text = '' THEN NULL WHEN sev IS NULL THEN 'INFO' ELSE {lvl} END AS log_level "
        f"FROM (SELECT doc_id, text, {SEV} AS sev FROM documents)"
    )


def _policy(policy: str) -> Builder:
    def build(spark, sf):
        d = _docs(spark, sf).withColumn("severity", M.severity(F.col("text")))
        return d.select(
            "doc_id", "severity",
            M.policy_output(F.col("text"), F.col("severity"), policy).alias("output"),
            M.log_level(F.col("text"), F.col("severity"), policy).alias("log_level"),
        )

    return build


for _p, _name in (("mask_and_log", "policy_mask"), ("block", "policy_block"), ("log_as_is", "policy_log_as_is")):
    register(_name, _policy_sql(_p))(_policy(_p))


@register("policy_drop", f"SELECT doc_id, text AS output FROM documents WHERE ({SEV}) IS NULL")
def policy_drop(spark, sf):
    """Filter form of BLOCK: flagged messages are dropped, the rest pass."""
    d = _docs(spark, sf)
    return d.where(M.severity(F.col("text")).isNull()).select("doc_id", F.col("text").alias("output"))


@register(
    "log_batch_status",
    f"SELECT doc_id, CASE WHEN sev IS NULL THEN 'CLEAN' WHEN sev = 'critical' THEN 'CRITICAL_BLOCKED' "
    f"ELSE 'MASKED' END AS status, CASE WHEN sev IS NULL THEN text WHEN sev = 'critical' THEN NULL "
    f"ELSE {MASKED} END AS output FROM (SELECT doc_id, text, {SEV} AS sev FROM documents)",
)
def log_batch_status(spark, sf):
    d = _docs(spark, sf).withColumn("sev", M.severity(F.col("text")))
    return d.select(
        "doc_id",
        M.batch_status(F.col("sev"), "mask_and_log").alias("status"),
        M.batch_output(F.col("text"), F.col("sev"), "mask_and_log").alias("output"),
    )


def _batch_status(policy: str, status: str, output: str) -> None:
    """Batch form of the other policies."""
    sql = (f"SELECT doc_id, CASE WHEN sev IS NULL THEN 'CLEAN' ELSE '{status}' END AS status, "
           f"CASE WHEN sev IS NULL THEN text ELSE {output} END AS output FROM (SELECT doc_id, text, {SEV} AS sev FROM documents)")

    @register(f"log_batch_status_{policy}", sql)
    def build(spark, sf):
        d = _docs(spark, sf).withColumn("sev", M.severity(F.col("text")))
        return d.select("doc_id", M.batch_status(F.col("sev"), policy).alias("status"),
                        M.batch_output(F.col("text"), F.col("sev"), policy).alias("output"))


_batch_status("block", "BLOCKED", "NULL")
_batch_status("log_as_is", "WARNING", "text")


@register(
    "corpus_stats",
    f"SELECT coalesce(sev, 'clean') AS severity, count(*) AS n, "
    f"round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct "
    f"FROM (SELECT {SEV} AS sev FROM documents) GROUP BY 1",
)
def corpus_stats(spark, sf):
    d = _docs(spark, sf).select(F.coalesce(M.severity(F.col("text")), F.lit("clean")).alias("severity"))
    g = d.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n")).scalar()   # at most four rows, as a scalar subquery
    return g.select("severity", "n", F.round(F.lit(100.0) * F.col("n") / total, 6).alias("pct"))


@register(
    "distinct_message_severity",
    f"SELECT text_hash, n_messages, {SEV} AS severity FROM (SELECT md5(text) AS text_hash, count(*) AS n_messages, "
    f"any_value(text) AS text FROM conversations GROUP BY 1)",
)
def distinct_message_severity(spark, sf):
    """Detect once per distinct text, then share the verdict (replaces an
    in-process LRU cache).  Grouping by the text keeps repeats together."""
    c = spread(table(spark, sf, "conversations").select("text"))
    g = c.groupBy(F.md5("text").alias("text_hash")).agg(
        F.count(F.lit(1)).alias("n_messages"), F.first("text").alias("text")
    )
    return g.select("text_hash", "n_messages", M.severity(F.col("text")).alias("severity"))


@register(
    "mask_log_keys",
    "SELECT doc_id, " + Q.log_keys_sql("text") + " AS masked FROM documents",
)
def mask_log_keys(spark, sf):
    return _docs(spark, sf).select("doc_id", M.mask_log_keys(F.col("text")).alias("masked"))


@register("detect_unicode_email",
          f"SELECT doc_id, {Q.severity_sql('text', unicode_email=True)} AS severity FROM documents")
def detect_unicode_email(spark, sf):
    """Severity with the Unicode e-mail fallback (checked only when the
    ASCII patterns miss)."""
    d = _docs(spark, sf)
    return d.select("doc_id", M.severity(F.col("text"), unicode_email_fallback=True).alias("severity"))


# ---------------------------------------------------------------- spans


def _ent_cols():
    return ["row_index", "column_ordinal", "column_name", "span_ord", "text", "pii_type",
            "start_pos", "end_pos", "confidence", "context", "detection_method"]


def _entities_query(ds: Dataset):
    def build(spark, sf):
        cfg = ds.config()
        return D.entities(ds.cells(spark, sf), cfg).select(*_ent_cols())

    sql = (f"WITH RECURSIVE {Q.entities_sql_ctes(ds.sql_source(), ds.sql_key(), list(ds.columns), ds.patterns())} "
           f"SELECT {', '.join(_ent_cols())} FROM ent")
    return build, sql


for _ds, _name in ((PEOPLE, "entities"), (DOCS, "doc_entities"), (PAGES, "page_entities")):
    _b, _s = _entities_query(_ds)
    register(_name, _s)(_b)


def _raw_query(ds: Dataset, patterns):
    def build(spark, sf):
        registry = PatternRegistry(tuple()).with_patterns(patterns)
        cells = ds.cells(spark, sf)
        raw = cells.select("row_index", "column_name", F.explode(D.raw_spans(F.col("cell_text"),
                                                                             ds.config(), registry)).alias("s"))
        return raw.select("row_index", "column_name", F.col("s.pii_type").alias("pii_type"),
                          F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"),
                          F.col("s.text").alias("text"))

    sql = (f"WITH cells AS ({Q.cells_sql(ds.sql_source(), ds.sql_key(), list(ds.columns))}) "
           f"SELECT row_index, column_name, pii_type, start_pos, end_pos, text FROM ({Q.raw_spans_sql('cells', patterns)})")
    return build, sql


_DETECT_NAMES = {
    "email_address": "detect_email", "phone_number": "detect_phone", "social_security_number": "detect_ssn",
    "credit_card": "detect_credit_card", "zip_code": "detect_zip", "ip_address": "detect_ip",
    "date_of_birth": "detect_dob", "api_key": "detect_api_key", "password": "detect_password",
}
for _t, _name in _DETECT_NAMES.items():
    _spec = pattern_for(_t)
    _b, _s = _raw_query(PEOPLE, [(_spec.pii_type, _spec.regex, _spec.flags)])
    register(_name, _s)(_b)

for _ds, _name in ((DOCS, "detect_documents"), (PAGES, "detect_pages")):
    # every built-in pattern over the text tables, before overlap resolution
    _b, _s = _raw_query(_ds, list(SPAN_PATTERNS))
    register(_name, _s)(_b)


@register("sanitize_formula", r"SELECT doc_id, regexp_replace(text, '^[=+\-@]', '') AS text FROM documents")
def sanitize_formula_q(spark, sf):
    return sanitize_formula(_docs(spark, sf), ["text"])


_b, _s = _raw_query(DOCS, list(SPAN_PATTERNS))
register("entity_spans", _s)(_b)

# User patterns: the example custom types plus a secret-token rule for the
# ``token = "<40 hex>"`` lines found in documents.
DOC_CUSTOM = list(CUSTOM_PATTERNS) + [("secret_token", r'\btoken\s*=\s*"[0-9a-f]{40}"', "")]
_b, _s = _raw_query(DOCS, DOC_CUSTOM)
register("detect_custom", _s)(_b)


@register("cells_unpivot",
          f"SELECT row_index, column_ordinal, column_name, cell_text FROM "
          f"({Q.cells_sql(PEOPLE.sql_source(), PEOPLE.sql_key(), list(PEOPLE.columns))})")
def cells_unpivot(spark, sf):
    return PEOPLE.cells(spark, sf)


def _mask_spans_sql(ds: Dataset) -> str:
    ctes = Q.entities_sql_ctes(ds.sql_source(), ds.sql_key(), list(ds.columns), ds.patterns())
    return f"""WITH RECURSIVE {ctes},
pieces AS (SELECT row_index, column_ordinal, column_name, cell_text, start_pos, end_pos,
  substring(cell_text, coalesce(lag(end_pos) OVER w, 0) + 1, start_pos - coalesce(lag(end_pos) OVER w, 0))
    || '[' || upper(pii_type) || '_REDACTED]' AS piece
  FROM ent WINDOW w AS (PARTITION BY row_index, column_ordinal ORDER BY start_pos))
SELECT row_index, column_name, string_agg(piece, '' ORDER BY start_pos)
  || substring(cell_text, max(end_pos) + 1) AS masked
FROM pieces GROUP BY row_index, column_ordinal, column_name, cell_text"""


@register("mask_spans", _mask_spans_sql(DOCS))
def mask_spans(spark, sf):
    """Span masking of every document cell that holds a span."""
    cells = DOCS.cells(spark, sf)
    kept = D.kept_spans(F.col("cell_text"), DOCS.config())
    return (D.bind_column(cells, "k", kept).where(F.size("k") > 0)
            .select("row_index", "column_name", S.mask_with_spans(F.col("cell_text"), F.col("k")).alias("masked")))


def _mask_table_sql(ds: Dataset) -> str:
    ctes = Q.entities_sql_ctes(ds.sql_source(), ds.sql_key(), list(ds.columns), ds.patterns())
    masked_cells = f"""pieces AS (SELECT row_index, column_ordinal, cell_text, start_pos, end_pos,
  substring(cell_text, coalesce(lag(end_pos) OVER w, 0) + 1, start_pos - coalesce(lag(end_pos) OVER w, 0))
    || '[' || upper(pii_type) || '_REDACTED]' AS piece
  FROM ent WINDOW w AS (PARTITION BY row_index, column_ordinal ORDER BY start_pos)),
mc AS (SELECT row_index, column_ordinal, string_agg(piece, '' ORDER BY start_pos)
  || substring(cell_text, max(end_pos) + 1) AS masked FROM pieces GROUP BY row_index, column_ordinal, cell_text)"""
    sel = ", ".join(
        f"coalesce((SELECT masked FROM mc WHERE mc.row_index = src.row_index AND mc.column_ordinal = {i}), "
        f"CAST(src.{c} AS VARCHAR)) AS {c}"
        for i, c in enumerate(ds.columns)
    )
    return (f"WITH RECURSIVE {ctes}, {masked_cells} SELECT src.{ds.sql_key()} AS row_index, {sel} "
            f"FROM {ds.sql_source()} src")


@register("mask_table", _mask_table_sql(PEOPLE))
def mask_table_q(spark, sf):
    return mask_table(PEOPLE.frame(spark, sf), "row_index", list(PEOPLE.columns), PEOPLE.config())


@register("span_preview", f"""WITH RECURSIVE {Q.entities_sql_ctes(PEOPLE.sql_source(), PEOPLE.sql_key(),
                                                          list(PEOPLE.columns), PEOPLE.patterns())}
SELECT row_index, column_name, span_ord, substring(text, 1, {NODE_TEXT_LEN}) AS node_text,
  CASE WHEN length(text) > {PREVIEW_LEN} THEN substring(text, 1, {PREVIEW_LEN}) || '...' ELSE text END AS text_preview,
  pii_type || ':' || substring(text, 1, 20) || '...' AS related_label FROM ent""")
def span_preview(spark, sf):
    """Privacy truncations: node text (50), cluster preview (20 + '...' when
    longer), related label (20 + '...' always)."""
    e = D.entities(PEOPLE.cells(spark, sf), PEOPLE.config())
    return e.select(
        "row_index", "column_name", "span_ord",
        F.substring("text", 1, NODE_TEXT_LEN).alias("node_text"),
        S.preview(F.col("text"), PREVIEW_LEN).alias("text_preview"),
        F.concat(F.col("pii_type"), F.lit(":"), F.substring("text", 1, 20), F.lit("...")).alias("related_label"),
    )


def queries() -> dict[str, Builder]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


# ---------------------------------------------------------------- analysed entities


def _analyzed(ds: Dataset, spark, sf) -> DataFrame:
    return A.analyze_cells(ds.cells(spark, sf), ds.config())


def _aent_sql(ds: Dataset) -> str:
    return Q.analyzed_sql_ctes(ds.sql_source(), ds.sql_key(), list(ds.columns), ds.patterns())


def _with_aent(ds: Dataset, select: str) -> str:
    """``select`` may start with ``, name AS (...)`` to add more CTEs."""
    sep = "" if select.startswith(",") else " "
    return f"WITH RECURSIVE {_aent_sql(ds)}{sep}{select}"


AENT_COLS = ["row_index", "column_name", "span_ord", "pii_type", "start_pos", "group_ord", "group_size",
             "risk_score", "risk_level", "detection_method", "base_method"]


@register("proximity_risk", _with_aent(PEOPLE, f"SELECT {', '.join(AENT_COLS)} FROM aent"))
def proximity_risk(spark, sf):
    return _analyzed(PEOPLE, spark, sf).select(*AENT_COLS)


@register("proximity_groups", _with_aent(
    PEOPLE, "SELECT row_index, column_name, group_ord, count(*) AS group_size, "
            "string_agg(pii_type, ',' ORDER BY span_ord) AS member_types FROM aent "
            "GROUP BY row_index, column_ordinal, column_name, group_ord HAVING count(*) > 1"))
def proximity_groups(spark, sf):
    """Groups of two or more spans (singleton groups are not groups)."""
    cfg = PEOPLE.config()
    framed = A.span_frame(PEOPLE.cells(spark, sf), cfg)
    from ..functions.risk import anchor_groups

    g = framed.select("row_index", "column_name",
                      F.posexplode(anchor_groups(F.col("spans"), cfg.proximity_window)).alias("group_ord", "g"))
    return g.where(F.size("g.members") > 1).select(
        "row_index", "column_name", "group_ord", F.size("g.members").alias("group_size"),
        F.array_join(F.transform("g.members", lambda m: m["pii_type"]), ",").alias("member_types"),
    )


@register("related_entities", _with_aent(
    PEOPLE, "SELECT row_index, column_name, span_ord, array_to_string(related_entities, '; ') AS related "
            "FROM aent WHERE group_size > 1"))
def related_entities(spark, sf):
    a = _analyzed(PEOPLE, spark, sf).where(F.col("group_size") > 1)
    return a.select("row_index", "column_name", "span_ord", F.array_join("related_entities", "; ").alias("related"))


@register("pair_risk", f"""WITH RECURSIVE {Q.entities_sql_ctes(PEOPLE.sql_source(), PEOPLE.sql_key(),
                                                          list(PEOPLE.columns), PEOPLE.patterns())},
pr(ta, tb, score) AS ({Q._values(__import__('veilspark.functions.patterns', fromlist=['x']).pair_risk_entries())})
SELECT a.row_index, a.column_name, a.span_ord AS src_ord, b.span_ord AS dst_ord, a.pii_type AS src_type,
  b.pii_type AS dst_type, b.start_pos - a.start_pos AS distance, coalesce(pr.score, 0.3::DOUBLE) AS pair_risk
FROM ent a JOIN ent b ON a.row_index = b.row_index AND a.column_ordinal = b.column_ordinal
  AND b.span_ord > a.span_ord AND b.start_pos - a.start_pos <= 100
LEFT JOIN pr ON pr.ta = a.pii_type AND pr.tb = b.pii_type""")
def pair_risk_q(spark, sf):
    """Proximity pairs (starts <= 100 apart in one cell) with their pair risk."""
    from ..functions.risk import pair_risk

    cfg = PEOPLE.config()
    p = A.proximity_pairs(A.span_frame(PEOPLE.cells(spark, sf), cfg), cfg, 100)
    return p.select("row_index", "column_name", "src_ord", "dst_ord", "src_type", "dst_type", "distance",
                    pair_risk(F.col("src_type"), F.col("dst_type")).alias("pair_risk"))


from ..operators import report as RP  # noqa: E402


@register("summary", _with_aent(
    PEOPLE, "SELECT count(*) AS total_entities, count(DISTINCT pii_type) AS n_types, "
            "coalesce(string_agg(DISTINCT pii_type, ',' ORDER BY pii_type), '') AS pii_types_detected, "
            "coalesce(string_agg(DISTINCT detection_method, ',' ORDER BY detection_method), '') AS detection_methods "
            "FROM aent"))
def summary_q(spark, sf):
    return RP.summary(_analyzed(PEOPLE, spark, sf))


for _col, _name in (("risk_level", "risk_distribution"), ("pii_type", "type_distribution"),
                    ("column_name", "column_distribution"), ("detection_method", "method_distribution")):
    def _mk(col):
        return lambda spark, sf: RP.distribution(_analyzed(PEOPLE, spark, sf), col)

    register(_name, _with_aent(PEOPLE, f"SELECT {_col}, count(*) AS count FROM aent GROUP BY 1"))(_mk(_col))


@register("risk_ratio", _with_aent(
    PEOPLE, "SELECT count(*) AS total, coalesce(sum(CASE WHEN risk_level IN ('high','critical') THEN 1 ELSE 0 END), 0) "
            "AS high_risk_count, coalesce(sum(CASE WHEN risk_level IN ('high','critical') THEN 1 ELSE 0 END), 0) "
            "/ greatest(count(*), 1) AS high_risk_ratio FROM aent"))
def risk_ratio_q(spark, sf):
    return RP.risk_ratio(_analyzed(PEOPLE, spark, sf))


def _regs_values() -> str:
    from ..functions.patterns import REGULATIONS

    rows = [(f"{i}", name, t, req) for i, (name, types, req) in enumerate(REGULATIONS) for t in types]
    return "VALUES " + ", ".join(f"({r[0]}, {Q.q(r[1])}, {Q.q(r[2])}, {Q.q(r[3])})" for r in rows)


@register("regulation_impact", _with_aent(
    PEOPLE, f""", regs(reg_order, regulation, pii_type, requirements) AS ({_regs_values()}),
pt AS (SELECT pii_type, count(*) AS n FROM aent GROUP BY 1)
SELECT regulation, coalesce(string_agg(CASE WHEN n > 0 THEN regs.pii_type END, ',' ORDER BY regs.pii_type), '')
  AS affected_pii_types, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_entities, coalesce(sum(n), 0) > 0 AS affected,
  requirements
FROM regs LEFT JOIN pt ON pt.pii_type = regs.pii_type GROUP BY reg_order, regulation, requirements""".lstrip()))
def regulation_impact_q(spark, sf):
    return RP.regulation_impact(_analyzed(PEOPLE, spark, sf))


def _compliance_sql() -> str:
    from ..functions.patterns import COMPLIANCE_TIERS

    tiers = [" | ".join(r) for _, r in COMPLIANCE_TIERS]
    score = ("CASE WHEN total > 0 THEN (n_critical * 1.0::DOUBLE + n_high * 0.7::DOUBLE + n_medium * 0.4::DOUBLE "
             "+ n_low * 0.1::DOUBLE) / total * 100.0::DOUBLE ELSE 0.0::DOUBLE END")
    rec = (f"CASE WHEN s > 70 THEN {Q.q(tiers[0])} WHEN s > 40 THEN {Q.q(tiers[1])} ELSE {Q.q(tiers[2])} END")
    return _with_aent(PEOPLE, f"""SELECT total AS total_pii_entities, round(s, 6) AS risk_score,
  split_part({rec}, ' | ', 1) AS tier, {rec} AS recommendations FROM (
  SELECT *, {score} AS s FROM (SELECT count(*) AS total,
    count(*) FILTER (WHERE risk_level = 'critical') AS n_critical, count(*) FILTER (WHERE risk_level = 'high') AS n_high,
    count(*) FILTER (WHERE risk_level = 'medium') AS n_medium, count(*) FILTER (WHERE risk_level = 'low') AS n_low
    FROM aent))""")


@register("compliance_report", _compliance_sql())
def compliance_report_q(spark, sf):
    return RP.compliance(_analyzed(PEOPLE, spark, sf))


@register("compliance_document", _with_aent(
    CHANNELS, f""", regs(reg_order, regulation, pii_type, requirements) AS ({_regs_values()}),
tot AS (SELECT count(*) AS total, coalesce(sum(CASE risk_level WHEN 'critical' THEN 10 WHEN 'high' THEN 7
  WHEN 'medium' THEN 4 ELSE 1 END), 0) AS tenths FROM aent)
SELECT regulation, string_agg(DISTINCT pii_type, ',' ORDER BY pii_type) AS affected_pii_types, count(*) AS n_entities,
  requirements, any_value(total) AS total_pii_entities, round(any_value(tenths * 10.0::DOUBLE / total), 6) AS risk_score,
  count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS n_high_risk
FROM aent JOIN regs USING (pii_type) CROSS JOIN tot GROUP BY regulation, requirements""".lstrip()))
def compliance_document_q(spark, sf):
    report = RP.compliance_document(_analyzed(CHANNELS, spark, sf), "")
    high = F.aggregate(
        F.filter("high_risk_by_type", lambda h: F.array_contains("r.affected_pii_types", h["pii_type"])),
        F.lit(0).cast("long"), lambda n, h: n + h["count"])
    return report.select("*", F.explode("affected_regulations").alias("r")).select(
        "r.regulation", F.array_join("r.affected_pii_types", ",").alias("affected_pii_types"), "r.n_entities",
        "r.requirements", "total_pii_entities", "risk_score", high.alias("n_high_risk"))


def _tagged(spark, sf) -> DataFrame:
    parts = [_analyzed(ds, spark, sf).withColumn("dataset", F.lit(ds.name)) for ds in (DOCS, PAGES, PEOPLE)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tagged_sql(select_from_aent: str) -> str:
    parts = [f"SELECT * FROM ({_with_aent(ds, f'SELECT {Q.q(ds.name)} AS dataset, * FROM aent')})"
             for ds in (DOCS, PAGES, PEOPLE)]
    return f"WITH tagged AS ({' UNION ALL '.join(parts)}) {select_from_aent}"


@register("batch_comparison", _tagged_sql(
    "SELECT dataset, count(*) AS total_entities, count(DISTINCT pii_type) AS n_types, "
    "coalesce(sum(CASE WHEN risk_level IN ('high','critical') THEN 1 ELSE 0 END), 0) AS high_risk_count "
    "FROM tagged GROUP BY 1"))
def batch_comparison_q(spark, sf):
    return RP.batch_comparison(_tagged(spark, sf))


@register("risk_heatmap", _tagged_sql(
    "SELECT dataset, " + ", ".join(f"count(*) FILTER (WHERE risk_level = '{k}') AS {k}"
                                   for k in ("low", "medium", "high", "critical")) + " FROM tagged GROUP BY 1"))
def risk_heatmap_q(spark, sf):
    return RP.risk_heatmap(_tagged(spark, sf))


HR_COLS = ["row_index", "column_name", "span_ord", "pii_type", "text", "risk_level", "risk_score"]


@register("high_risk_entities", _with_aent(
    PEOPLE, f"SELECT {', '.join(HR_COLS)} FROM aent WHERE risk_level IN ('high', 'critical')"))
def high_risk_entities(spark, sf):
    return RP.high_risk(_analyzed(PEOPLE, spark, sf)).select(*HR_COLS)


@register("high_risk_by_type", _with_aent(
    PEOPLE, "SELECT pii_type, count(*) AS count FROM aent WHERE risk_level IN ('high', 'critical') GROUP BY 1"))
def high_risk_by_type(spark, sf):
    return RP.distribution(RP.high_risk(_analyzed(PEOPLE, spark, sf)), "pii_type")


@register("top5_high_risk", _with_aent(
    PEOPLE, f"SELECT {', '.join(HR_COLS)} FROM aent WHERE risk_level IN ('high', 'critical') "
            "ORDER BY row_index, column_ordinal, span_ord LIMIT 5"))
def top5_high_risk(spark, sf):
    return RP.first_k(RP.high_risk(_analyzed(PEOPLE, spark, sf)), 5).select(*HR_COLS)


@register("top3_per_type", _with_aent(
    PEOPLE, "SELECT pii_type, row_index, column_name, span_ord, text, rank FROM (SELECT *, row_number() OVER "
            "(PARTITION BY pii_type ORDER BY row_index, column_ordinal, span_ord) AS rank FROM aent) WHERE rank <= 3"))
def top3_per_type(spark, sf):
    return RP.top_per_type(_analyzed(PEOPLE, spark, sf), 3).select(
        "pii_type", "row_index", "column_name", "span_ord", "text", "rank")


@register("column_profile", _with_aent(
    PEOPLE, f""", c AS (SELECT column_ordinal, column_name, count(*) AS n_cells FROM cells GROUP BY 1, 2),
e AS (SELECT column_ordinal, count(*) AS n_entities, count(DISTINCT row_index) AS n_cells_with_pii,
  string_agg(DISTINCT pii_type, ',' ORDER BY pii_type) AS pii_types FROM aent GROUP BY 1)
SELECT column_name, n_cells, coalesce(n_cells_with_pii, 0) AS n_cells_with_pii, coalesce(n_entities, 0) AS n_entities,
  coalesce(pii_types, '') AS pii_types FROM c LEFT JOIN e USING (column_ordinal)""".lstrip()))
def column_profile_q(spark, sf):
    return RP.column_profile(PEOPLE.cells(spark, sf), PEOPLE.config())


# ---------------------------------------------------------------- graph

from ..operators import graph as G  # noqa: E402


def _as_long(df, column):
    """The library counts pairs in decimals; the given tables' counts fit a long."""
    return df.withColumn(column, F.col(column).cast("long"))


def _graph_inputs(spark, sf, ds: Dataset = PEOPLE):
    """Risk rows, explicit edges, counts per (row, column, type) and proximity pairs.

    One detection pass leaves the spans' positions and types (no texts) in
    the shared folder; everything else is derived from that small table."""
    cfg = ds.config()
    bones = materialize(A.skeleton(A.span_frame(ds.cells(spark, sf), cfg)), "skeleton")
    pairs = A.proximity_pairs(bones, cfg, cfg.graph_window)
    return cfg, A.risk_rows(bones, cfg), G.explicit_edges(pairs, cfg), G.span_type_counts(bones), pairs


def _graph_sql(select: str, ds: Dataset = PEOPLE) -> str:
    from ..functions.patterns import semantic_entries

    return _with_aent(ds, f""", nodes AS (SELECT pii_type || '_' || row_index || '_' || column_ordinal || '_' ||
  span_ord AS node_id, * FROM aent),
sem(a, b, w) AS ({Q._values(semantic_entries())}),
cand AS (
  SELECT x.node_id AS src, y.node_id AS dst FROM nodes x JOIN nodes y ON x.row_index = y.row_index
    AND (x.column_ordinal, x.span_ord) < (y.column_ordinal, y.span_ord)
  UNION
  SELECT x.node_id, y.node_id FROM nodes x JOIN nodes y ON x.column_ordinal = y.column_ordinal
    AND (x.row_index, x.span_ord) < (y.row_index, y.span_ord)
  UNION
  SELECT x.node_id, y.node_id FROM nodes x JOIN sem ON sem.a = x.pii_type JOIN nodes y ON sem.b = y.pii_type
    AND (x.row_index, x.column_ordinal, x.span_ord) < (y.row_index, y.column_ordinal, y.span_ord)
  UNION
  SELECT y.node_id, x.node_id FROM nodes x JOIN sem ON sem.a = x.pii_type JOIN nodes y ON sem.b = y.pii_type
    AND (y.row_index, y.column_ordinal, y.span_ord) < (x.row_index, x.column_ordinal, x.span_ord)),
ge AS (SELECT c.src, c.dst,
  CASE WHEN sem.w IS NOT NULL THEN 'semantic'
       WHEN x.row_index = y.row_index AND x.column_ordinal = y.column_ordinal
            AND abs(x.start_pos - y.start_pos) <= 100 THEN 'proximity'
       WHEN x.row_index = y.row_index THEN 'row_co_occurrence' ELSE 'column_co_occurrence' END AS edge_type,
  CASE WHEN sem.w IS NOT NULL THEN sem.w
       WHEN x.row_index = y.row_index AND x.column_ordinal = y.column_ordinal
            AND abs(x.start_pos - y.start_pos) <= 100
       THEN greatest(0.1::DOUBLE, 1.0::DOUBLE - abs(x.start_pos - y.start_pos) / 100.0::DOUBLE)
       WHEN x.row_index = y.row_index THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS weight
  FROM cand c JOIN nodes x ON x.node_id = c.src JOIN nodes y ON y.node_id = c.dst
  LEFT JOIN sem ON sem.a = least(x.pii_type, y.pii_type) AND sem.b = greatest(x.pii_type, y.pii_type))
{select}""")


@register("graph_nodes", _with_aent(
    PEOPLE, "SELECT pii_type || '_' || row_index || '_' || column_ordinal || '_' || span_ord AS node_id, pii_type, "
            "substring(text, 1, 50) AS text, confidence, risk_level, row_index, column_name, detection_method "
            "FROM aent"))
def graph_nodes(spark, sf):
    return G.nodes(_analyzed(PEOPLE, spark, sf)).select("node_id", "pii_type", "text", "confidence", "risk_level", "row_index",
                               "column_name", "detection_method")


@register("proximity_edges", _with_aent(PEOPLE, f""", sem(a, b, w) AS ({Q._values(
    __import__('veilspark.functions.patterns', fromlist=['x']).semantic_entries())})
SELECT x.pii_type || '_' || x.row_index || '_' || x.column_ordinal || '_' || x.span_ord AS src,
  y.pii_type || '_' || y.row_index || '_' || y.column_ordinal || '_' || y.span_ord AS dst,
  coalesce(sem.w, greatest(0.1::DOUBLE, 1.0::DOUBLE - (y.start_pos - x.start_pos) / 100.0::DOUBLE)) AS weight,
  CASE WHEN sem.w IS NULL THEN 'proximity' ELSE 'semantic' END AS edge_type,
  y.start_pos - x.start_pos AS distance
FROM aent x JOIN aent y ON x.row_index = y.row_index AND x.column_ordinal = y.column_ordinal
  AND y.span_ord > x.span_ord AND y.start_pos - x.start_pos <= 100
LEFT JOIN sem ON sem.a = least(x.pii_type, y.pii_type) AND sem.b = greatest(x.pii_type, y.pii_type)"""))
def proximity_edges(spark, sf):
    _, _, edges, _, _ = _graph_inputs(spark, sf)
    return edges.select("src", "dst", "weight", "edge_type", "distance")


NEAR = "x.row_index = y.row_index AND x.column_ordinal = y.column_ordinal AND abs(x.start_pos - y.start_pos) <= 100"


@register("graph_edges", _graph_sql(f""", g AS (SELECT ge.*, {NEAR} AS near, abs(x.start_pos - y.start_pos) AS distance,
  x.row_index, x.column_ordinal, least(x.pii_type, y.pii_type) AS type_a, greatest(x.pii_type, y.pii_type) AS type_b
  FROM ge JOIN nodes x ON x.node_id = ge.src JOIN nodes y ON y.node_id = ge.dst)
SELECT src, dst, edge_type, weight, CAST(distance AS INTEGER) AS distance, 1::BIGINT AS edges FROM g WHERE near
UNION ALL SELECT 'type_' || type_a, 'type_' || type_b, edge_type, weight, NULL, count(*) FROM g
  WHERE NOT near AND edge_type = 'semantic' GROUP BY type_a, type_b, edge_type, weight
UNION ALL SELECT 'row_' || row_index, 'row_' || row_index, edge_type, weight, NULL, count(*) FROM g
  WHERE edge_type = 'row_co_occurrence' GROUP BY row_index, edge_type, weight
UNION ALL SELECT 'column_' || column_ordinal, 'column_' || column_ordinal, edge_type, weight, NULL, count(*) FROM g
  WHERE edge_type = 'column_co_occurrence' GROUP BY column_ordinal, edge_type, weight"""))
def graph_edges_q(spark, sf):
    """Every edge of the graph once: listed pairs and counted hubs."""
    cfg, _, _, rct, pairs = _graph_inputs(spark, sf)
    return _as_long(G.graph_edges(pairs, rct, cfg), "edges")


@register("edge_types", _graph_sql("SELECT edge_type, count(*) AS count FROM ge GROUP BY 1"))
def edge_types(spark, sf):
    cfg, _, edges, rct, _ = _graph_inputs(spark, sf)
    return _as_long(G.edge_type_counts(G.edge_class_totals(rct, edges, cfg)), "count")


@register("edge_weight_stats", _graph_sql(
    "SELECT count(*) AS total_edges, round(avg(weight), 9) AS mean_weight, round(stddev_pop(weight), 9) AS std_weight,"
    " round(min(weight), 9) AS min_weight, round(max(weight), 9) AS max_weight FROM ge"))
def edge_weight_stats(spark, sf):
    cfg, _, edges, rct, _ = _graph_inputs(spark, sf)
    return _as_long(G.edge_weight_stats(G.edge_class_totals(rct, edges, cfg)), "total_edges")


@register("degree_centrality", _graph_sql(
    ", deg AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM ge UNION ALL "
    "SELECT dst FROM ge) GROUP BY 1) "
    "SELECT n.node_id, n.pii_type, n.row_index, n.column_name, coalesce(d.degree, 0) AS degree, "
    "round(coalesce(d.degree, 0) / (count(*) OVER () - 1), 9) AS degree_centrality "
    "FROM nodes n LEFT JOIN deg d USING (node_id)"))
def degree_centrality(spark, sf):
    cfg, ent, _, rct, _ = _graph_inputs(spark, sf)
    return G.degree_centrality(ent, rct, cfg)


def _hub_sql(select: str) -> str:
    """Components through the column/type hub graph (see operators.graph)."""
    from ..functions.patterns import semantic_entries

    pairs = [(a, b) for a, b, _ in semantic_entries()] + [(b, a) for a, b, _ in semantic_entries()]
    sp = "VALUES " + ", ".join(f"({Q.q(a)}, {Q.q(b)})" for a, b in pairs)
    return _with_aent(PEOPLE, f""", nodes AS (SELECT pii_type || '_' || row_index || '_' || column_ordinal || '_' ||
  span_ord AS node_id, 'c:' || lpad(CAST(column_ordinal AS VARCHAR), 6, '0') AS hub, * FROM aent),
sp(t, partner) AS ({sp}),
live AS (SELECT * FROM sp WHERE t IN (SELECT pii_type FROM nodes) AND partner IN (SELECT pii_type FROM nodes)),
rc AS (SELECT DISTINCT row_index, hub FROM nodes),
hub_edges(u, v) AS (
  SELECT hub, nxt FROM (SELECT hub, lead(hub) OVER (PARTITION BY row_index ORDER BY hub) AS nxt FROM rc)
    WHERE nxt IS NOT NULL
  UNION SELECT DISTINCT hub, 't:' || pii_type FROM nodes WHERE pii_type IN (SELECT t FROM live)
  UNION SELECT 't:' || t, 't:' || partner FROM live),
und(u, v) AS (SELECT u, v FROM hub_edges UNION SELECT v, u FROM hub_edges),
verts(u) AS (SELECT hub FROM nodes UNION SELECT u FROM und),
reach(u, v) AS (SELECT u, u FROM verts UNION SELECT r.u, e.v FROM reach r JOIN und e ON r.v = e.u),
lab AS (SELECT u AS hub, min(v) AS label FROM reach GROUP BY u),
cm AS (SELECT n.*, l.label FROM nodes n JOIN lab l USING (hub)),
comp AS (SELECT label, arg_min(node_id, (row_index, column_ordinal, span_ord)) AS component_id, count(*) AS size,
  min((row_index, column_ordinal, span_ord)) AS first_key FROM cm GROUP BY label),
comp2 AS (SELECT *, row_number() OVER (ORDER BY first_key) - 1 AS cluster_rank FROM comp),
scored AS (SELECT cm.*, CASE risk_level WHEN 'low' THEN 0.25::DOUBLE WHEN 'medium' THEN 0.5::DOUBLE
  WHEN 'high' THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS score FROM cm),
cl AS (SELECT c.cluster_rank AS cluster_id, c.component_id, count(*) AS size, avg(score) AS a, max(score) AS m,
  count(DISTINCT pii_type) / count(*) AS d
  FROM scored s JOIN comp2 c USING (label) GROUP BY 1, 2 HAVING count(*) >= 2),
clusters AS (SELECT cluster_id, component_id, size, round(a, 9) AS average_risk_score, round(m, 9) AS max_risk_score,
  round(d, 9) AS type_diversity,
  round(least(1.0::DOUBLE, 0.4::DOUBLE * a + 0.3::DOUBLE * m + 0.2::DOUBLE * d
    + 0.1::DOUBLE * least(1.0::DOUBLE, size / 5.0::DOUBLE)), 9) AS overall_risk FROM cl)
{select}""")


@register("components", _hub_sql("SELECT component_id, size, cluster_rank FROM comp2"))
def components_q(spark, sf):
    cfg, ent, _, rct, _ = _graph_inputs(spark, sf)
    return G.components(ent, rct, cfg)[1]


@register("risk_clusters", _hub_sql("SELECT * FROM clusters"))
def risk_clusters_q(spark, sf):
    cfg, ent, _, rct, _ = _graph_inputs(spark, sf)
    return G.risk_clusters(ent, rct, cfg)


@register("top_clusters", _hub_sql("SELECT * FROM clusters ORDER BY overall_risk DESC, cluster_id LIMIT 3"))
def top_clusters_q(spark, sf):
    cfg, ent, _, rct, _ = _graph_inputs(spark, sf)
    return G.risk_clusters(ent, rct, cfg).orderBy(F.desc("overall_risk"), "cluster_id").limit(3)


@register("cluster_members", _hub_sql(
    "SELECT cm.node_id, c.component_id, c.cluster_rank FROM cm JOIN comp2 c USING (label)"))
def cluster_members_q(spark, sf):
    """Entity -> component membership (the entity lists of clusters, kept as
    rows rather than one unbounded array per cluster)."""
    cfg, ent, _, rct, _ = _graph_inputs(spark, sf)
    m, s = G.components(ent, rct, cfg)
    return m.join(F.broadcast(s.select("component_id", "cluster_rank")), "component_id").select(
        "node_id", "component_id", "cluster_rank")



# components of the enumerated pairs, not of the hub graph
_PAIR_COMPONENTS = """, k AS (SELECT *, row_number() OVER (ORDER BY row_index, column_ordinal, span_ord) AS k FROM nodes),
p AS (SELECT x.k AS a, y.k AS b FROM ge JOIN k x ON x.node_id = ge.src JOIN k y ON y.node_id = ge.dst),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach(a, m) AS (SELECT k, k FROM k UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.m),
label AS (SELECT a AS k, min(m) AS first FROM reach GROUP BY a),
member AS (SELECT k.*, f.node_id AS component_id, dense_rank() OVER (ORDER BY label.first) - 1 AS cluster_rank,
    CASE k.risk_level WHEN 'low' THEN 0.25::DOUBLE WHEN 'medium' THEN 0.5::DOUBLE WHEN 'high' THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS score
  FROM k JOIN label USING (k) JOIN k f ON f.k = label.first)"""


@register("channel_components", _graph_sql(
    f"{_PAIR_COMPONENTS} SELECT component_id, count(*) AS size, cluster_rank FROM member GROUP BY component_id, cluster_rank", CHANNELS))
def channel_components(spark, sf):
    """Components of a graph that falls apart: several columns, two that meet, a single entity."""
    cfg, ent, _, rct, _ = _graph_inputs(spark, sf, CHANNELS)
    return G.components(ent, rct, cfg)[1]


@register("channel_clusters", _graph_sql(
    f"""{_PAIR_COMPONENTS} SELECT cluster_rank AS cluster_id, component_id, count(*) AS size, round(avg(score), 9) AS average_risk_score,
  round(max(score), 9) AS max_risk_score, round(count(DISTINCT pii_type) / count(*), 9) AS type_diversity,
  round(least(1.0::DOUBLE, 0.4::DOUBLE * avg(score) + 0.3::DOUBLE * max(score) + 0.2::DOUBLE * (count(DISTINCT pii_type) / count(*))
    + 0.1::DOUBLE * least(1.0::DOUBLE, count(*) / 5.0::DOUBLE)), 9) AS overall_risk
FROM member GROUP BY component_id, cluster_rank HAVING count(*) >= 2""", CHANNELS))
def channel_clusters(spark, sf):
    cfg, ent, _, rct, _ = _graph_inputs(spark, sf, CHANNELS)
    return G.risk_clusters(ent, rct, cfg)


def _metrics_sql() -> str:
    edges = _graph_sql("SELECT count(*) AS m FROM ge")
    comps = _hub_sql("SELECT count(*) AS k, max(size) AS largest FROM comp2")
    n = _with_aent(PEOPLE, "SELECT count(*) AS n FROM aent")
    return (f"SELECT n AS num_nodes, m AS num_edges, round(CASE WHEN n > 1 THEN 2.0 * m / (n * (n - 1)) ELSE 0.0 END, 9)"
            f" AS density, k = 1 AS is_connected, k AS n_components, largest AS largest_component_size "
            f"FROM ({n}) a, ({edges}) b, ({comps}) c")


@register("graph_metrics", _metrics_sql())
def graph_metrics_q(spark, sf):
    cfg, ent, edges, rct, _ = _graph_inputs(spark, sf)
    return _as_long(G.graph_metrics(ent, rct, G.edge_class_totals(rct, edges, cfg), cfg), "num_edges")


# ---------------------------------------------------------------- gazetteer, verdicts

from ..operators import gazetteer as GZ  # noqa: E402
from ..operators.verdict import apply_verdict_policy, verdict_join  # noqa: E402
from ..operators.cells import to_cells  # noqa: E402

GEO_COLUMNS = ["full_name", "country", "segment"]
GEO_SQL = ("SELECT c_custkey AS row_index, c_name AS full_name, n_name AS country, c_mktsegment AS segment "
           "FROM customer JOIN nation ON c_nationkey = n_nationkey")
GAZ_SQL = ("SELECT n_name AS phrase, 'GPE' AS label FROM nation UNION ALL SELECT r_name, 'LOC' FROM region "
           "UNION ALL SELECT s_name, 'ORG' FROM supplier UNION ALL SELECT c_name, 'PERSON' FROM customer "
           "UNION ALL SELECT DISTINCT c_mktsegment, 'NORP' FROM customer")


def _geo_cells(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    df = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("row_index"), F.col("c_name").alias("full_name"),
        F.col("n_name").alias("country"), F.col("c_mktsegment").alias("segment"))
    return to_cells(spread(df), "row_index", GEO_COLUMNS)


def _gazetteer(spark, sf):
    t = lambda n: table(spark, sf, n)
    parts = [
        t("nation").select(F.col("n_name").alias("phrase"), F.lit("GPE").alias("label")),
        t("region").select(F.col("r_name").alias("phrase"), F.lit("LOC").alias("label")),
        t("supplier").select(F.col("s_name").alias("phrase"), F.lit("ORG").alias("label")),
        t("customer").select(F.col("c_name").alias("phrase"), F.lit("PERSON").alias("label")),
        t("customer").select(F.col("c_mktsegment").alias("phrase"), F.lit("NORP").alias("label")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ngram_sql() -> str:
    tok = Q.raw_spans_sql("cells", [("token", r"[\p{L}\p{N}_#]+", "")])
    return f"""cells AS ({Q.cells_sql(f"({GEO_SQL})", "row_index", GEO_COLUMNS)}),
tok AS (SELECT *, row_number() OVER (PARTITION BY row_index, column_ordinal ORDER BY start_pos) AS k FROM ({tok})),
grams AS (SELECT row_index, column_ordinal, column_name, start_pos AS start, end_pos AS "end", text AS phrase FROM tok
  UNION ALL
  SELECT a.row_index, a.column_ordinal, a.column_name, a.start_pos, b.end_pos,
    substring(a.cell_text, a.start_pos + 1, b.end_pos - a.start_pos)
  FROM tok a JOIN tok b ON a.row_index = b.row_index AND a.column_ordinal = b.column_ordinal AND b.k > a.k),
gz AS (SELECT DISTINCT phrase, label FROM ({GAZ_SQL})),
hits AS (SELECT g.*, gz.label FROM grams g JOIN gz USING (phrase))"""


@register("detect_gazetteer", f"WITH {_ngram_sql()} SELECT row_index, column_name, start, \"end\", phrase, label FROM hits")
def detect_gazetteer(spark, sf):
    m = GZ.gazetteer_matches(_geo_cells(spark, sf), _gazetteer(spark, sf))
    return m.select("row_index", "column_name", "start", "end", "phrase", "label")


@register("ner_label_map", f"WITH {_ngram_sql()}, lm(label, pii_type) AS (VALUES " + ", ".join(
    f"({Q.q(a)}, {Q.q(b)})" for a, b in __import__('veilspark.functions.patterns', fromlist=['x']).NER_LABELS)
    + ") SELECT row_index, column_name, start, \"end\", phrase AS text, pii_type FROM hits JOIN lm USING (label)")
def ner_label_map(spark, sf):
    m = GZ.map_labels(GZ.gazetteer_matches(_geo_cells(spark, sf), _gazetteer(spark, sf)))
    return m.select("row_index", "column_name", "start", "end", F.col("phrase").alias("text"), "pii_type")


def _mixed_sql() -> str:
    """Regex and gazetteer spans, resolved one after the other by a recursive
    walk that carries the open span of each cell."""
    n = len(SPAN_PATTERNS)
    labels = "VALUES " + ", ".join(f"({Q.q(a)}, {Q.q(b)})" for a, b in NER_LABELS)
    same = "{0}.row_index = {1}.row_index AND {0}.column_ordinal = {1}.column_ordinal".format
    return f"""WITH RECURSIVE {_ngram_sql()}, lm(label, pii_type) AS ({labels}),
raw AS ({Q.raw_spans_sql('cells')}),
every AS (SELECT row_index, column_ordinal, column_name, cell_text, prio, pii_type, text, start_pos, end_pos,
    0.9::DOUBLE AS confidence, 'regex' AS base_method FROM raw
  UNION ALL SELECT h.row_index, h.column_ordinal, h.column_name, c.cell_text, {n}, lm.pii_type, h.phrase, h.start, h."end", 0.8::DOUBLE, 'ner'
  FROM hits h JOIN lm USING (label) JOIN cells c ON {same('c', 'h')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_index, column_ordinal
  ORDER BY start_pos, prio, end_pos, text, pii_type) AS rn FROM every),
sweep AS (SELECT row_index, column_ordinal, rn, rn AS open, end_pos AS until, confidence AS sure, CAST(NULL AS BIGINT) AS closed
    FROM ranked WHERE rn = 1
  UNION ALL SELECT n.row_index, n.column_ordinal, n.rn,
    CASE WHEN n.start_pos >= s.until OR n.confidence > s.sure THEN n.rn ELSE s.open END,
    CASE WHEN n.start_pos >= s.until OR n.confidence > s.sure THEN n.end_pos ELSE s.until END,
    CASE WHEN n.start_pos >= s.until OR n.confidence > s.sure THEN n.confidence ELSE s.sure END,
    CASE WHEN n.start_pos >= s.until THEN s.open END
  FROM sweep s JOIN ranked n ON {same('n', 's')} AND n.rn = s.rn + 1),
chosen AS (SELECT row_index, column_ordinal, closed AS rn FROM sweep WHERE closed IS NOT NULL
  UNION ALL SELECT row_index, column_ordinal, arg_max(open, rn) FROM sweep GROUP BY row_index, column_ordinal),
ent AS (SELECT r.*, CAST(row_number() OVER (PARTITION BY row_index, column_ordinal ORDER BY start_pos) - 1 AS INTEGER) AS span_ord,
  '' AS context FROM ranked r JOIN chosen USING (row_index, column_ordinal, rn)),
{Q.risk_sql_ctes()}
SELECT row_index, column_name, span_ord, text, pii_type, start_pos, end_pos, confidence, base_method, risk_level FROM aent"""


@register("entities_with_gazetteer", _mixed_sql())
def entities_with_gazetteer(spark, sf):
    """Regex and gazetteer spans resolved together (mixed confidence: a
    regex span replaces an overlapping gazetteer span, never the reverse)."""
    from ..config import VeilConfig

    cells = _geo_cells(spark, sf)
    spans = GZ.gazetteer_spans(cells, _gazetteer(spark, sf))
    cfg = VeilConfig()
    with_extra = GZ.spans_per_cell(cells, spans, prio_base=len(cfg.registry))
    ent = A.entities_from_spans(A.span_frame(with_extra, cfg, extra=F.col("extra")), cfg)
    return ent.select("row_index", "column_name", "span_ord", "text", "pii_type", "start_pos", "end_pos",
                      "confidence", "base_method", "risk_level")


VERDICT_SQL = ("SELECT d.text, CASE WHEN l.toxic = 1 THEN 'PII_DETECTED' ELSE 'NO_PII' END AS verdict "
               "FROM documents d JOIN labels l USING (doc_id)")


@register("verdict_join", f"""WITH v AS ({VERDICT_SQL}),
j AS (SELECT t.text, coalesce(v.verdict = 'PII_DETECTED', true) AS is_pii
  FROM (SELECT DISTINCT text FROM documents) t LEFT JOIN (SELECT text, max(verdict) AS verdict FROM v GROUP BY 1) v
  USING (text))
SELECT doc_id, is_pii, CASE WHEN is_pii THEN '[PII DETECTED BY LLM] ' || d.text ELSE d.text END AS output
FROM documents d LEFT JOIN j USING (text)""")
def verdict_join_q(spark, sf):
    """Verdicts stand in for a model judge's answers; here they are derived
    from ``labels`` (documents without a label have no verdict -> PII)."""
    docs = _docs(spark, sf)
    labels = table(spark, sf, "labels")
    verdicts = docs.join(labels, "doc_id").select(
        "text", F.when(F.col("toxic") == 1, "PII_DETECTED").otherwise("NO_PII").alias("verdict"))
    judged = verdict_join(docs, verdicts)
    return apply_verdict_policy(judged, "warn_and_log").select("doc_id", "is_pii", "output")


@register("row_edges", _graph_sql(
    "SELECT x.row_index, count(*) AS row_edges FROM ge JOIN nodes x ON x.node_id = ge.src "
    "WHERE edge_type = 'row_co_occurrence' GROUP BY 1"))
def row_edges_q(spark, sf):
    cfg, _, edges, rct, _ = _graph_inputs(spark, sf)
    return _as_long(G.row_edge_counts(rct, edges, cfg), "row_edges")


@register("column_edges", _graph_sql(
    "SELECT x.column_ordinal, count(*) AS column_edges FROM ge JOIN nodes x ON x.node_id = ge.src "
    "WHERE edge_type = 'column_co_occurrence' GROUP BY 1"))
def column_edges_q(spark, sf):
    cfg, _, _, rct, _ = _graph_inputs(spark, sf)
    return _as_long(G.column_edge_counts(rct, cfg), "column_edges")


@register("semantic_edges", _graph_sql(
    "SELECT least(x.pii_type, y.pii_type) AS type_a, greatest(x.pii_type, y.pii_type) AS type_b, "
    "count(*) AS edges, any_value(weight) AS weight FROM ge JOIN nodes x ON x.node_id = ge.src "
    "JOIN nodes y ON y.node_id = ge.dst WHERE edge_type = 'semantic' GROUP BY 1, 2"))
def semantic_edges_q(spark, sf):
    cfg, _, _, rct, _ = _graph_inputs(spark, sf)
    return _as_long(G.semantic_edge_counts(rct, cfg), "edges")


@register("eigenvector_centrality", None)
def eigenvector_centrality_q(spark, sf):
    """Power iteration (iterative, so no SQL oracle; unit-tested against a
    brute-force power iteration)."""
    cfg, ent, _, rct, _ = _graph_inputs(spark, sf)
    return G.eigenvector_centrality(ent, rct, cfg)


@register("entity_pairs", _with_aent(PEOPLE, f""", pr2(ta, tb, score) AS ({Q._values(
    __import__('veilspark.functions.patterns', fromlist=['x']).pair_risk_entries())})
SELECT a.row_index, a.column_name, a.group_ord, a.span_ord AS src_ord, b.span_ord AS dst_ord,
  a.pii_type AS src_type, b.pii_type AS dst_type, coalesce(pr2.score, 0.3::DOUBLE) AS pair_risk
FROM aent a JOIN aent b ON a.row_index = b.row_index AND a.column_ordinal = b.column_ordinal
  AND a.group_ord = b.group_ord AND b.span_ord > a.span_ord
LEFT JOIN pr2 ON pr2.ta = a.pii_type AND pr2.tb = b.pii_type"""))
def entity_pairs(spark, sf):
    """Pairs inside each proximity group with their pair risk."""
    cfg = PEOPLE.config()
    p = A.group_pairs(A.span_frame(PEOPLE.cells(spark, sf), cfg), cfg)
    return p.select("row_index", "column_name", "group_ord", "src_ord", "dst_ord", "src_type", "dst_type",
                    "pair_risk")


LINE_SEV = Q.severity_sql("line")
LINE_MASKED = Q.mask_message_sql("line")


@register("log_lines_policy", f"""SELECT doc_id, line_no, sev AS severity,
  CASE WHEN line IS NULL OR line = '' THEN NULL WHEN sev IS NULL THEN line
       WHEN sev = 'critical' THEN '[BLOCKED] Message contained critical PII' ELSE {LINE_MASKED} END AS output
FROM (SELECT doc_id, line_no, line, {LINE_SEV} AS sev FROM (
  SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))""")
def log_lines_policy(spark, sf):
    """Every line of every document as a log message under mask_and_log."""
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    sev = M.severity(F.col("line"))
    w = lines.withColumn("severity", sev)
    return w.select("doc_id", "line_no", "severity",
                    M.policy_output(F.col("line"), F.col("severity"), "mask_and_log").alias("output"))
