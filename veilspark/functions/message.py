"""Column expressions of the log-message agent: severity, masking, policy.

Severity checks the classes in order (critical, sensitive, contextual) with
one alternation per class, so a message is scanned at most three times and
``CASE WHEN`` stops at the first class that hits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import (
    BLOCKED_CRITICAL,
    LOG_KEY_PATTERNS,
    MESSAGE_MAX_LEN,
    MESSAGE_RULES,
    MESSAGE_SEVERITY_ORDER,
    UNICODE_EMAIL,
    WARNING_PREFIX,
    pattern_for,
)

POLICIES = ("log_as_is", "mask_and_log", "block")


def class_regex(severity: str, unicode: bool = True) -> str:
    alts = []
    for sev, ptype, _tok in MESSAGE_RULES:
        if sev == severity:
            spec = pattern_for(ptype)
            alts.append(f"(?{spec.flags}:{spec.regex})" if spec.flags else f"(?:{spec.regex})")
    head = "(?U)" if unicode else ""
    return head + "|".join(alts)


def _class_guard(severity: str, text: Column, unicode: bool) -> Column | None:
    """OR of the guards of a severity class (None if one member has none)."""
    from .spans import guard_expr

    out = None
    for sev, ptype, _tok in MESSAGE_RULES:
        if sev != severity:
            continue
        g = guard_expr(text, pattern_for(ptype), unicode)
        if g is None:
            return None
        out = g if out is None else (out | g)
    return out


def severity(text: Column, max_len: int = MESSAGE_MAX_LEN, oversize: str = "scan",
             unicode: bool = True, unicode_email_fallback: bool = False) -> Column:
    """Highest severity of a message, or null when clean.

    Every text is read whole.  ``oversize`` can instead ask for a length gate
    on messages longer than ``max_len``: ``clean`` treats them as clean
    (fails open), ``block`` reports them as critical.
    """
    expr = F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
    if oversize == "clean":
        expr = expr.when(F.length(text) > max_len, F.lit(None).cast("string"))
    elif oversize == "block":
        expr = expr.when(F.length(text) > max_len, F.lit("critical"))
    elif oversize != "scan":
        raise ValueError(f"oversize must be clean, scan or block, not {oversize!r}")
    for sev in MESSAGE_SEVERITY_ORDER:
        hit = text.rlike(class_regex(sev, unicode))
        g = _class_guard(sev, text, unicode)
        expr = expr.when(hit if g is None else (g & hit), F.lit(sev))
    if unicode_email_fallback:
        expr = expr.when(text.rlike("(?iU)" + UNICODE_EMAIL), F.lit("sensitive"))
    return expr.otherwise(F.lit(None).cast("string"))


def has_pii(text: Column, **kw) -> Column:
    return severity(text, **kw).isNotNull()


def mask_message(text: Column, unicode: bool = True, unicode_email: bool = False) -> Column:
    """Pattern masking in severity order with short tokens; later patterns
    see the output of earlier ones (order is part of the contract)."""
    out = text
    for _sev, ptype, tok in MESSAGE_RULES:  # each step is named once: linear in the rules
        out = F.regexp_replace(out, pattern_for(ptype).java(unicode), tok)
    if unicode_email:
        out = F.regexp_replace(out, "(?iU)" + UNICODE_EMAIL, "[EMAIL_REDACTED]")
    return out


def severity_of(text: Column, cfg) -> Column:
    """Severity with every option of the config; the one form that operators use."""
    return severity(text, cfg.max_message_len, cfg.oversize, cfg.unicode_regex, cfg.unicode_email_fallback)


def masked_of(text: Column, cfg) -> Column:
    """Masking that covers whatever ``severity_of`` detects."""
    return mask_message(text, cfg.unicode_regex, cfg.unicode_email_fallback)


def mask_log_keys(text: Column) -> Column:
    out = text
    for regex, tok in LOG_KEY_PATTERNS:
        out = F.regexp_replace(out, regex, tok)
    return out


def policy_output(text: Column, sev: Column, policy: str, masked: Column | None = None,
                  warning_prefix: str = WARNING_PREFIX, blocked_critical: str = BLOCKED_CRITICAL) -> Column:
    """What the log sink receives under ``policy`` (null = nothing logged)."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    masked = masked if masked is not None else mask_message(text)
    empty = text.isNull() | (text == "")
    out = F.when(empty, F.lit(None).cast("string")).when(sev.isNull(), text)
    if policy == "log_as_is":
        return out.otherwise(F.concat(F.lit(warning_prefix), text))
    if policy == "mask_and_log":
        return out.when(sev == "critical", F.lit(blocked_critical)).otherwise(masked)
    return out.otherwise(F.concat(F.lit("[BLOCKED] Message contained "), sev, F.lit(" PII")))


def log_level(text: Column, sev: Column, policy: str) -> Column:
    empty = text.isNull() | (text == "")
    lvl = F.when(empty, F.lit(None).cast("string")).when(sev.isNull(), F.lit("INFO"))
    return lvl.otherwise(F.lit("WARNING") if policy == "log_as_is" else F.lit("INFO"))


def batch_status(sev: Column, policy: str) -> Column:
    """Status of the batch form: CLEAN, BLOCKED, CRITICAL_BLOCKED, MASKED, WARNING."""
    st = F.when(sev.isNull(), F.lit("CLEAN"))
    if policy == "block":
        return st.otherwise(F.lit("BLOCKED"))
    if policy == "mask_and_log":
        return st.when(sev == "critical", F.lit("CRITICAL_BLOCKED")).otherwise(F.lit("MASKED"))
    return st.otherwise(F.lit("WARNING"))


def batch_output(text: Column, sev: Column, policy: str, masked: Column | None = None) -> Column:
    masked = masked if masked is not None else mask_message(text)
    st = batch_status(sev, policy)
    return (
        F.when(st == "CLEAN", text)
        .when(st == "MASKED", masked)
        .when(st == "WARNING", text)
        .otherwise(F.lit(None).cast("string"))
    )


def text_digest(text) -> Column:
    """SHA-256 of a text as 32 bytes: a key for joins and state that doesn't grow with the text."""
    return F.unhex(F.sha2(F.col(text) if isinstance(text, str) else text, 256))
