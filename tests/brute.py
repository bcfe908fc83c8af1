"""Small pure-Python oracles for tests (brute force, not used by the library)."""

from __future__ import annotations

import re

from veilspark.functions.patterns import (
    MESSAGE_RULES,
    SPAN_PATTERNS,
    pair_risk_entries,
    semantic_entries,
)


def compile_all(patterns=SPAN_PATTERNS):
    return [(t, re.compile(r, re.IGNORECASE if "i" in f else 0)) for t, r, f in patterns]


def raw_spans(text, patterns=SPAN_PATTERNS):
    out = []
    for prio, (t, rx) in enumerate(compile_all(patterns)):
        for m in rx.finditer(text):
            out.append((m.start(), m.end(), prio, m.group(), t))
    return out


def kept_spans(text, patterns=SPAN_PATTERNS):
    """Greedy by (start, registry order); equal confidence never replaces."""
    kept = []
    for s in sorted(raw_spans(text, patterns), key=lambda x: (x[0], x[2])):
        if all(not (s[0] < k[1] and s[1] > k[0]) for k in kept):
            kept.append(s)
    return kept


def mask(text, spans):
    out = text
    for s, e, _p, _m, t in sorted(spans, key=lambda x: x[0], reverse=True):
        out = out[:s] + f"[{t.upper()}_REDACTED]" + out[e:]
    return out


def severity(msg, max_len=10000):
    if not msg or len(msg) > max_len:
        return None
    pats = dict((t, rx) for t, rx in compile_all())
    for sev in ("critical", "sensitive", "contextual"):
        for s, t, _tok in MESSAGE_RULES:
            if s == sev and pats[t].search(msg):
                return sev
    return None


def mask_message(msg):
    pats = dict((t, rx) for t, rx in compile_all())
    for _s, t, tok in MESSAGE_RULES:
        msg = pats[t].sub(tok, msg)
    return msg


PAIR = {(a, b): s for a, b, s in pair_risk_entries()}
SEM = {}
for a, b, w in semantic_entries():
    SEM[(a, b)] = w
    SEM[(b, a)] = w


def graph_edges(entities):
    """entities: list of dicts (row_index, column_ordinal, span_ord, pii_type,
    start_pos) in entity order.  Returns {(i, j): (type, weight)}."""
    edges = {}
    n = len(entities)
    for i in range(n):
        a = entities[i]
        for j in range(i + 1, n):
            b = entities[j]
            same_cell = a["row_index"] == b["row_index"] and a["column_ordinal"] == b["column_ordinal"]
            d = abs(a["start_pos"] - b["start_pos"])
            sem = SEM.get((a["pii_type"], b["pii_type"]))
            if sem is not None:
                edges[(i, j)] = ("semantic", sem)
            elif same_cell and d <= 100:
                edges[(i, j)] = ("proximity", max(0.1, 1 - d / 100))
            elif a["row_index"] == b["row_index"]:
                edges[(i, j)] = ("row_co_occurrence", 0.3)
            elif a["column_ordinal"] == b["column_ordinal"]:
                edges[(i, j)] = ("column_co_occurrence", 0.2)
    return edges


def components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in edges:
        ri, rj = find(i), find(j)
        if ri != rj:
            parent[max(ri, rj)] = min(ri, rj)
    return [find(i) for i in range(n)]
