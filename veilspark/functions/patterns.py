"""Pattern registry and the fixed lookup values that results depend on.

Everything in the FIXED VALUES block below must stay equal to the behaviour
being matched (regex text, redaction tokens, type names, risk scores,
regulation lists).  They are stated once, plainly, in natural order.  The
rest of the module only turns them into small Spark DataFrames or SQL
snippets; none of it grows with the data, so every table built here is safe
to broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference behaviour for identical results)
# ---------------------------------------------------------------------------

# Span-detector regexes in registry order (this order breaks start-position
# ties during overlap resolution).  Flags: "i" = ignore case.
SPAN_PATTERNS = [
    ("email_address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "i"),
    ("phone_number", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", ""),
    ("social_security_number", r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b", ""),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", ""),
    ("zip_code", r"\b\d{5}(?:-\d{4})?\b", ""),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", ""),
    ("date_of_birth", r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b", ""),
    ("api_key", r"\b(?:api[_-]?key|apikey|access[_-]?token)[\s:=]+[\w-]{20,}\b", "i"),
    ("password", r"\b(?:password|passwd|pwd)[\s:=]+\S+\b", "i"),
]

# Confidence given to regex spans and to model/gazetteer (NER-style) spans.
REGEX_CONFIDENCE = 0.9
NER_CONFIDENCE = 0.8

# Message (log) detector: severity classes in checking order, each with its
# (pattern name, redaction token) list in masking order.
MESSAGE_SEVERITY_ORDER = ["critical", "sensitive", "contextual"]
MESSAGE_RULES = [
    ("critical", "social_security_number", "[SSN_REDACTED]"),
    ("critical", "credit_card", "[CC_REDACTED]"),
    ("sensitive", "email_address", "[EMAIL_REDACTED]"),
    ("sensitive", "phone_number", "[PHONE_REDACTED]"),
    ("sensitive", "ip_address", "[IP_REDACTED]"),
    ("sensitive", "password", "[PASSWORD_REDACTED]"),
    ("contextual", "api_key", "[API_KEY_REDACTED]"),
]
MESSAGE_MAX_LEN = 10000

# Unicode e-mail fallback of the enhanced message agent (severity sensitive).
UNICODE_EMAIL = r"[\w._%+-]+@[\w.-]+\.[\w]{2,}"

# Policy output texts.
WARNING_PREFIX = "[WARNING: PII DETECTED] "
BLOCKED_CRITICAL = "[BLOCKED] Message contained critical PII"

# Example custom patterns (employee id, project code, API token, licence plate).
CUSTOM_PATTERNS = [
    ("employee_id", r"\bEMP-\d{6}\b", ""),
    ("project_code", r"\bPROJ-[A-Z]{3}-\d{4}\b", ""),
    ("api_token", r"\bsk_[a-zA-Z0-9]{32}\b", ""),
    ("license_plate", r"\b[A-Z]{2,3}[-\s]?\d{3,4}[-\s]?[A-Z]{0,3}\b", ""),
]

# Log key-mask patterns (sample code in the reference's review notes), applied
# in this order.  The hyphen in the first class is escaped so that the class
# reads the same in Java, RE2 and Python.
LOG_KEY_PATTERNS = [
    (r"AIza[0-9A-Za-z\-_]{35}", "[API_KEY_MASKED]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_MASKED]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_MASKED]"),
]

# NER label -> PII type (labels mapped to nothing are dropped).
NER_LABELS = [
    ("PERSON", "person_name"),
    ("ORG", "organization"),
    ("GPE", "location"),
    ("LOC", "location"),
    ("FAC", "location"),
]

# Base risk per type: critical 0.9, high 0.7, medium 0.5, everything else low 0.3.
BASE_RISK_CRITICAL = ["social_security_number", "credit_card", "passport", "drivers_license", "bank_account"]
BASE_RISK_HIGH = ["date_of_birth", "physical_address", "medical_identifier"]
BASE_RISK_MEDIUM = ["person_name", "email_address", "phone_number"]
RISK_THRESHOLDS = [("critical", 0.85), ("high", 0.65), ("medium", 0.45)]
DEFAULT_PAIR_RISK = 0.3
PROXIMITY_PAIR_FACTOR = 0.5

# Pair risk matrix (symmetric).  The 0.6 list is applied last, so a pair in
# both lists ends at 0.6.
PAIR_RISK_HIGH = [
    ("person_name", "social_security_number"),
    ("person_name", "date_of_birth"),
    ("person_name", "physical_address"),
    ("email_address", "phone_number"),
    ("person_name", "phone_number"),
    ("organization", "email_address"),
    ("zip_code", "physical_address"),
    ("person_name", "credit_card"),
]
PAIR_RISK_MEDIUM = [
    ("person_name", "organization"),
    ("email_address", "organization"),
    ("phone_number", "physical_address"),
    ("location", "zip_code"),
    ("person_name", "email_address"),
    ("person_name", "location"),
]
PAIR_RISK_HIGH_SCORE = 0.9
PAIR_RISK_MEDIUM_SCORE = 0.6

# Semantic edge weights (looked up in either direction).
SEMANTIC_WEIGHTS = [
    ("person_name", "email_address", 0.8),
    ("person_name", "phone_number", 0.8),
    ("person_name", "physical_address", 0.9),
    ("organization", "email_address", 0.7),
    ("organization", "physical_address", 0.8),
    ("physical_address", "zip_code", 0.9),
    ("email_address", "username", 0.6),
]
ROW_EDGE_WEIGHT = 0.3
COLUMN_EDGE_WEIGHT = 0.2
GRAPH_PROXIMITY_WINDOW = 100

# Cluster scoring: risk level scores and weights of avg, max, diversity, size.
CLUSTER_LEVEL_SCORE = [("low", 0.25), ("medium", 0.5), ("high", 0.75), ("critical", 1.0)]
CLUSTER_WEIGHTS = (0.4, 0.3, 0.2, 0.1)
CLUSTER_SIZE_NORM = 5.0

# Compliance score weights and recommendation tiers.
COMPLIANCE_WEIGHTS = [("critical", 1.0), ("high", 0.7), ("medium", 0.4), ("low", 0.1)]
COMPLIANCE_TIERS = [
    (70, [
        "CRITICAL: Immediate remediation required",
        "Implement data encryption at rest and in transit",
        "Review and restrict data access permissions",
    ]),
    (40, [
        "HIGH: Significant PII exposure detected",
        "Implement data masking for sensitive fields",
        "Enable audit logging for all data access",
    ]),
    (None, [
        "MODERATE: Standard security measures recommended",
        "Regular security reviews recommended",
    ]),
]

# Regulations: (name, affected types, requirements), in report order.
REGULATIONS = [
    ("GDPR", ["person_name", "email_address", "phone_number", "physical_address", "ip_address"],
     "Requires explicit consent, right to erasure, data portability"),
    ("HIPAA", ["person_name", "social_security_number", "medical_identifier", "date_of_birth"],
     "Requires encryption, access controls, audit logs"),
    ("PCI_DSS", ["credit_card", "bank_account"],
     "Requires tokenization, network segmentation, regular security scans"),
    ("CCPA", ["person_name", "email_address", "phone_number", "ip_address", "physical_address"],
     "Requires opt-out mechanism, data disclosure, non-discrimination"),
]

# Context window and privacy truncation lengths.
CONTEXT_WINDOW = 50
NODE_TEXT_LEN = 50
PREVIEW_LEN = 20
RELATED_LEN = 20

# ---------------------------------------------------------------------------
# End of fixed values
# ---------------------------------------------------------------------------


def java_regex(pattern: str, flags: str = "", unicode: bool = True) -> str:
    """Pattern text for Spark (java.util.regex).

    ``unicode`` adds ``(?U)`` so that ``\\b \\d \\w \\s`` follow Unicode
    classes the way Python's ``re`` does on ``str``; ``(?U)`` also turns on
    Unicode-aware case folding for ``i``.
    """
    prefix = ("U" if unicode else "") + flags
    return f"(?{prefix}){pattern}" if prefix else pattern


def re2_regex(pattern: str, flags: str = "") -> str:
    """Pattern text for RE2 (DuckDB oracle).  RE2 classes are ASCII-only and
    ``(?U)`` would mean *ungreedy* there, so only ``i`` is carried over."""
    return f"(?{flags}){pattern}" if flags else pattern


# Necessary conditions of the built-in patterns (derived from the regexes,
# not reference values): a text that fails its guard cannot match, so the
# pattern is skipped without changing any result.  ("contains", s) is a byte
# search; ("regex", r) is a cheap scan using the pattern's own flags.
GUARDS = {
    "email_address": ("contains", "@"),
    "phone_number": ("regex", r"\d"),
    "social_security_number": ("regex", r"\d"),
    "credit_card": ("regex", r"\d"),
    "zip_code": ("regex", r"\d"),
    "ip_address": ("regex", r"\d"),
    "date_of_birth": ("regex", r"\d"),
    "api_key": ("regex", r"api|access"),
    "password": ("regex", r"pass|pwd"),
}


@dataclass(frozen=True)
class PatternSpec:
    pii_type: str
    regex: str
    flags: str = ""
    confidence: float = REGEX_CONFIDENCE
    method: str = "regex"
    guard: tuple | None = None

    def __post_init__(self):
        # an empty match has no characters to mask; refused where Python can tell
        try:
            found = re.compile(self.regex, re.I if "i" in self.flags else 0)
        except re.error:
            return
        if any(not m.group() for probe in ("", "aA1 _-.@/") for m in found.finditer(probe)):
            raise ValueError(f"pattern of {self.pii_type} matches empty text: {self.regex!r}")

    def java(self, unicode: bool = True) -> str:
        return java_regex(self.regex, self.flags, unicode)

    def re2(self) -> str:
        return re2_regex(self.regex, self.flags)


@dataclass(frozen=True)
class PatternRegistry:
    """Ordered list of span patterns.  Order = tie-break priority."""

    specs: tuple[PatternSpec, ...] = field(default_factory=tuple)

    @classmethod
    def default(cls) -> "PatternRegistry":
        return cls(tuple(PatternSpec(t, r, f, guard=GUARDS.get(t)) for t, r, f in SPAN_PATTERNS))

    def with_patterns(self, extra) -> "PatternRegistry":
        """Append user patterns ``(pii_type, regex[, flags[, confidence]])``."""
        specs = list(self.specs)
        for item in extra:
            if isinstance(item, PatternSpec):
                specs.append(item)
            else:
                t, r, *rest = item
                flags = rest[0] if rest else ""
                conf = rest[1] if len(rest) > 1 else REGEX_CONFIDENCE
                specs.append(PatternSpec(t, r, flags, conf))
        return replace(self, specs=tuple(specs))

    def only(self, *types: str) -> "PatternRegistry":
        return replace(self, specs=tuple(s for s in self.specs if s.pii_type in types))

    def __iter__(self):
        return iter(self.specs)

    def __len__(self):
        return len(self.specs)


def pattern_for(pii_type: str) -> PatternSpec:
    for t, r, f in SPAN_PATTERNS:
        if t == pii_type:
            return PatternSpec(t, r, f, guard=GUARDS.get(t))
    raise KeyError(pii_type)


def base_risk_score(pii_type: str) -> float:
    if pii_type in BASE_RISK_CRITICAL:
        return 0.9
    if pii_type in BASE_RISK_HIGH:
        return 0.7
    if pii_type in BASE_RISK_MEDIUM:
        return 0.5
    return 0.3


def pair_risk_entries() -> list[tuple[str, str, float]]:
    """Symmetric pair-risk entries; later list wins on duplicates."""
    out: dict[tuple[str, str], float] = {}
    for pairs, score in ((PAIR_RISK_HIGH, PAIR_RISK_HIGH_SCORE), (PAIR_RISK_MEDIUM, PAIR_RISK_MEDIUM_SCORE)):
        for a, b in pairs:
            out[(a, b)] = score
            out[(b, a)] = score
    return [(a, b, s) for (a, b), s in out.items()]


def semantic_entries() -> list[tuple[str, str, float]]:
    """Semantic weights keyed by the ordered pair (least, greatest)."""
    out: dict[tuple[str, str], float] = {}
    for a, b, w in SEMANTIC_WEIGHTS:
        key = (min(a, b), max(a, b))
        out.setdefault(key, w)
    return [(a, b, w) for (a, b), w in out.items()]
