"""Operator 4, PII [native]: expressions propose, validators confirm, context scores.

Everything is a column expression over the whole text of a row: no shuffle,
no Python.  For each kind ``regexp_extract_all`` gives the matches and
``split`` by the same pattern the text between them, so a running sum of
lengths gives code-point offsets; the sum is folded in blocks, which keeps a
text with very many matches from copying its whole result for each of them.
The patterns start only where a run starts (or where the last match ended) and
use possessive quantifiers, which finds the same matches as the plain
patterns in time linear in the text and without recursion.

Base kinds keep every match that its validator confirms: e-mail addresses, IP
addresses (parts at most 255), cards (16 to 19 digits, Luhn) and international
phone numbers (8 to 15 digits).  The method adds further kinds whose shape
alone says too little: IBANs (mod-97), 13- to 15-digit cards (Luhn), US social
security and national phone numbers.  Those start from a score for their
shape, gain ``CHECKSUM_GAIN`` from a checksum and ``CONTEXT_GAIN`` from a
word of their context list within ``CONTEXT_CHARS`` code points, lose
``CONTEXT_LOSS`` next to a word of the counter list, and count from
``THRESHOLD`` on.  IBANs and short cards are proposed at each start of a word or
digit group with every end at a separator; of the ends whose checksum holds the
one of the country's IBAN length is taken, else the longest, and a span inside
an earlier one of its kind is dropped.

Defined results: a null text counts as empty; an empty text has no span;
null or repeated doc_ids keep their rows; an empty table gives no row; other
columns are ignored (``mask`` passes them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: base patterns: leftmost matches as stated by the contract, written without backtracking
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: texts that can't match are not scanned
GUARD = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9]",
}
IP_VALID = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)){3}$"

#: added kinds: pattern, shape score, context words (fixed values of this operator)
ADDED = {
    "iban": (r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}", 0.2,
             "iban|account|konto|cuenta|compte|bank"),
    "short_card": (r"(?<![0-9])(?=([0-9](?:[\x20-]?[0-9]){12,14}+[0-9]?))[0-9]", 0.1, "card|visa|amex|credit|debit|karte|carte|tarjeta"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security|taxpayer"),
    "local_phone": (r"(?<![0-9+.-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", 0.3,
                    "call|phone|tel|telephone|mobile|fax|telefon|anrufen|llame"),
}
ADDED_GUARD = r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]|[0-9]{3}\)?[\x20.-][0-9]|[0-9](?:[\x20-]?[0-9]){12}"
#: country and length of the registered IBANs
IBAN_LENGTHS = (
    "NO15 BE16 DK18 FI18 FK18 FO18 GL18 NL18 SD18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 MN20 XK20 CH21 HR21 LI21 LV21 "
    "BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 AE23 GI23 IL23 IQ23 OM23 SO23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 "
    "SA24 SE24 SK24 TN24 VG24 LY25 PT25 IS26 TR26 BI27 DJ27 FR27 GR27 IT27 MC27 MR27 SM27 AL28 AZ28 BY28 CY28 DO28 GT28 "
    "HU28 LB28 NI28 PL28 SV28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 YE30 MT31 SC31 LC32 RU33").split()
COUNTER_WORDS = "order|invoice|version|serial|isbn|part"
CONTEXT_CHARS = 40
CHECKSUM_GAIN, CONTEXT_GAIN, CONTEXT_LOSS, THRESHOLD = 0.35, 0.3, 0.2, 0.5
BLOCK = 1024
SPAN = "struct<s:int,e:int,m:string>"


def _spans(text: Column, pattern: str, guard: Column, ahead: bool = False) -> Column:
    """Array of (s, e, m): code-point start, end and text of each match, in order; ``ahead``: with the
    first group, which may reach beyond the match, as its text."""
    empty = F.array().cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    shown = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if ahead else found
    gaps = F.split(text, pattern, -1)

    def positions(both: Column) -> Column:
        matches, between, texts = both["m"], both["g"], both["x" if ahead else "m"]
        n = F.size(matches)

        def one(state, i):
            at = state["pos"] + F.length(F.get(between, i))
            end = at + F.length(F.get(matches, i))
            return F.struct(end.alias("pos"), F.array_append(
                state["out"], F.struct(at.alias("s"), end.alias("e"), F.get(texts, i).alias("m"))).alias("out"))

        def block(state, first):
            return F.aggregate(
                F.sequence(first, F.least(first + BLOCK, n) - 1),
                F.struct(state["pos"].alias("pos"), empty.alias("out")), one,
                lambda r: F.struct(r["pos"].alias("pos"), F.concat(state["out"], r["out"]).alias("out")))

        folded = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)),
                             F.struct(F.lit(0).alias("pos"), empty.alias("out")), block, lambda r: r["out"])
        return F.when(n > 0, folded).otherwise(empty)

    # let-bind the two regex results: the fold refers to them many times
    bound = F.transform(F.array(F.struct(found.alias("m"), gaps.alias("g"), *(
        [shown.alias("x")] if ahead else []))), positions)
    return F.when(guard, F.get(bound, F.lit(0))).otherwise(empty)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the string of digits has a Luhn sum divisible by ten."""
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the IBAN's check digits hold (country and check digits moved to the end)."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_VALID)
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _score(kind: str, span: Column, text: Column) -> Column:
    """Score of an added kind's candidate; null where the checksum refutes it."""
    _, shape, words = ADDED[kind]
    near = F.substring(text, F.greatest(span["s"] - CONTEXT_CHARS, F.lit(0)) + 1,
                       span["e"] - span["s"] + 2 * CONTEXT_CHARS)
    score = (F.lit(shape) + F.when(near.rlike(rf"(?i)\b(?:{words})\b"), CONTEXT_GAIN).otherwise(0.0)
             - F.when(near.rlike(rf"(?i)\b(?:{COUNTER_WORDS})\b"), CONTEXT_LOSS).otherwise(0.0))
    return score + CHECKSUM_GAIN if kind in CUT else score


#: kinds proposed with every end at a separator
CUT = ("iban", "short_card")


def _fits(kind: str, plain: Column) -> Column:
    if kind == "iban":
        return F.length(plain).between(15, 34) & plain.rlike("^[A-Z0-9]+$") & mod97(plain)
    return F.length(plain).between(13, 15) & luhn(plain)


def _cutter(kind: str):
    """(s, e, m) with the best end whose checksum holds; null end if there is none."""
    def cut(x):
        words = F.split(x["m"], "[\x20-]")
        ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.struct(
            F.length(F.array_join(F.slice(words, 1, k), " ")).alias("n"), F.array_join(F.slice(words, 1, k), "").alias("m")))
        best = F.array_max(F.transform(F.filter(ends, lambda c: _fits(kind, c["m"])), lambda c: F.struct(
            F.concat(F.substring(c["m"], 1, 2), F.length(c["m"]).cast("string")).isin(IBAN_LENGTHS).alias("known"),
            c["n"].alias("n"), c["m"].alias("m"))))
        return F.struct(x["s"].alias("s"), (x["s"] + best["n"]).alias("e"), best["m"].alias("m"))
    return cut


def _outermost(spans: Column) -> Column:
    """Spans that aren't inside an earlier one."""
    return F.filter(spans, lambda x: ~F.exists(spans, lambda y: (y["s"] < x["s"]) & (x["e"] <= y["e"])))


# lambdas that depend on a kind (Spark counts a lambda's parameters, so no defaults)

def _keeper(kind: str):
    return lambda x: _confirmed(kind, x["m"])


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def _named(kind: str, text: Column | None = None):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"),
                              (F.lit(1.0) if text is None else _score(kind, x, text)).alias("score"))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with column ``_pii``: array of (kind, s, e, score), base kinds first, by kind then start."""
    out = docs.withColumn("_t", text_or_empty(text))
    t = F.col("_t")
    for kind, pattern in BASE.items():
        out = out.withColumn(f"_raw_{kind}", _spans(t, pattern, t.rlike(GUARD[kind])))
    for kind in BASE:
        out = out.withColumn(f"_{kind}", F.filter(f"_raw_{kind}", _keeper(kind)))
    out = out.withColumn("_base", F.concat(*[F.col(f"_{k}") for k in BASE]))
    may = t.rlike(ADDED_GUARD)
    added = []
    for kind, (pattern, _, _) in ADDED.items():
        out = out.withColumn(f"_may_{kind}", _spans(t, pattern, may, ahead=kind in CUT))
        proposed = F.col(f"_may_{kind}")
        if kind in CUT:
            out = out.withColumn(f"_cut_{kind}", F.filter(
                F.transform(proposed, _cutter(kind)), lambda x: x["e"].isNotNull()))
            proposed = F.col(f"_cut_{kind}")
        scored = F.transform(proposed, _named(kind, t))
        out = out.withColumn(f"_add_{kind}", F.filter(scored, lambda x: x["score"] >= THRESHOLD))
        counted = F.col(f"_add_{kind}")
        added.append(F.filter(_outermost(counted) if kind in CUT else counted, lambda x: ~F.exists(
            "_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))
    base = [F.transform(f"_{k}", _named(k)) for k in BASE]
    out = out.withColumn("_pii", F.concat(*base, *added))
    return out.drop("_t", "_base", *[f"_raw_{k}" for k in BASE], *[f"_{k}" for k in BASE],
                    *[f"_{c}_{k}" for c in ("add", "may", "cut") for k in ADDED])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans per document."""
    found = detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.filter("_pii", lambda x: x["kind"].isin(*BASE))
    count = [F.size(F.filter("_pii", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *count, F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("_pii")).alias("spans"))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span (overlapping ones as one) replaced by ``[KIND]``."""
    found = detect(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                               F.col(f"`{text}`").alias("_text")), "_text")
    spans = F.array_sort(F.transform("_pii", lambda x: F.struct(x["s"], x["e"], x["kind"])))
    chars = F.split("_text", "")

    def masked(both):
        letters = both["c"]

        def step(state, x):
            gap = F.array_join(F.slice(letters, state["pos"] + 1, x["s"] - state["pos"]), "")
            tag = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
            return F.when(x["s"] >= state["pos"], F.struct(
                x["e"].alias("pos"), F.array_append(state["out"], F.concat(gap, tag)).alias("out"))).otherwise(
                F.struct(F.greatest(x["e"], state["pos"]).alias("pos"), state["out"].alias("out")))

        return F.aggregate(both["s"], F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")),
                           step, lambda r: F.concat(F.array_join(r["out"], ""), F.array_join(
                               F.slice(letters, r["pos"] + 1, F.greatest(F.size(letters) - r["pos"], F.lit(0))), "")))

    bound = F.transform(F.array(F.struct(chars.alias("c"), spans.alias("s"))), masked)
    return found.withColumn("_text", F.when(F.size("_pii") > 0, F.get(bound, F.lit(0))).otherwise(F.col("_text"))).select(
        *[(F.col("_text") if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns])
