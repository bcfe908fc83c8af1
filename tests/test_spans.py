"""Span offsets, overlap resolution, masking and context against a Python oracle."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from veilspark.config import VeilConfig
from veilspark.functions import spans as S
from veilspark.functions.patterns import PatternRegistry
from veilspark.operators import detect as D
from veilspark.operators.cells import to_cells
from veilspark.operators.mask import mask_table, sanitize_formula


def spark_kept(spark, texts, cfg=VeilConfig()):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = (df.withColumn("k", D.kept_spans(F.col("text"), cfg))
            .select("i", "k", S.mask_with_spans(F.col("text"), F.col("k")).alias("m")).orderBy("i"))
    return [([(s.start, s.end, s.prio, s.text, s.pii_type) for s in r.k], r.m) for r in rows.collect()]


SAMPLES = [
    "Contact john.doe@example.com or call (555) 123-4567 today",
    "SSN 123-45-6789, card 4111 1111 1111 1111, zip 90210-1234, ip 10.0.0.1, dob 12/31/1999",
    "api_key=abcdefghijklmnopqrstuvwx and password: hunter2! done",
    "+1 555 123 4567 and 5551234567 and 123456789",
    "😀 mail: émile@exämple.com 😀 then bob@example.org",
    "",
    "no pii here",
]


def test_offsets_dedup_and_mask_match_python(spark):
    got = spark_kept(spark, SAMPLES)
    for text, (kept, masked) in zip(SAMPLES, got):
        exp = brute.kept_spans(text)
        assert kept == exp, text
        for s, e, _p, m, _t in kept:
            assert text[s:e] == m
        assert masked == brute.mask(text, exp)


def test_same_start_tie_goes_to_registry_order(spark):
    # e-mail (registry 0) and IP (registry 5) both start at 0; the e-mail
    # is longer and comes first in the registry, so it is kept
    (kept, masked), = spark_kept(spark, ["10.1.2.3.a@b.io"])
    assert [(k[0], k[1], k[4]) for k in kept] == [(0, 15, "email_address")]
    assert kept == brute.kept_spans("10.1.2.3.a@b.io")


def test_tie_break_is_registry_order_not_longest(spark):
    # "123456789" is both a bare SSN and part of a phone-like run; earliest
    # start wins, then registry order
    (kept, _), = spark_kept(spark, ["id 123-456-7890 x"])
    assert [k[4] for k in kept] == ["phone_number"]
    (kept, _), = spark_kept(spark, ["4111-1111-1111-1111"])
    assert [k[4] for k in kept] == ["credit_card"]


FRAGMENTS = st.sampled_from([
    "a@b.io", " ", "555-123-4567", "123-45-6789", "4111 1111 1111 1111", "10.1.2.3", "12/31/1999",
    "password: x1", "api_key=", "abcdefghijklmnopqrstu", "é", "😀", "9", ".", "-", "x",
])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(FRAGMENTS, min_size=1, max_size=14).map("".join), min_size=30, max_size=30))
def test_property_against_python(spark, texts):
    # one Spark job checks a whole batch of generated texts
    for text, (kept, masked) in zip(texts, spark_kept(spark, texts)):
        exp = brute.kept_spans(text)
        assert kept == exp, text
        assert masked == brute.mask(text, exp)
        assert all(kept[i + 1][0] >= kept[i][1] for i in range(len(kept) - 1))


def test_mixed_confidence_rule(spark):
    # a 0.8 model span [0, 16) is kept first (earlier start); the 0.9 regex
    # span [15, 26) overlaps it and, being more confident, replaces it
    df = spark.createDataFrame([("Jane Doe Smith 123-45-6789",)], "text string")
    extra = S.ner_spans_from_array(F.array(
        F.struct(F.lit(0).alias("start"), F.lit(16).alias("end"), F.lit("Jane Doe Smith 1").alias("text"),
                 F.lit("person_name").alias("pii_type")),
    ), 100)
    k = df.withColumn("extra", extra).select(
        D.kept_spans(F.col("text"), VeilConfig(), extra=F.col("extra")).alias("k")).first().k
    assert [(s.start, s.pii_type) for s in k] == [(15, "social_security_number")]
    # same start: the regex span ranks first and the model span is dropped
    extra2 = S.ner_spans_from_array(F.array(
        F.struct(F.lit(15).alias("start"), F.lit(20).alias("end"), F.lit("123-4").alias("text"),
                 F.lit("person_name").alias("pii_type")),
    ), 100)
    k2 = df.withColumn("extra", extra2).select(
        D.kept_spans(F.col("text"), VeilConfig(), extra=F.col("extra")).alias("k")).first().k
    assert [(s.start, s.pii_type) for s in k2] == [(15, "social_security_number")]


def test_context_window(spark):
    text = "x" * 59 + " a@b.io " + "y" * 69
    df = spark.createDataFrame([(0, text)], "row_index long, text string")
    e = D.entities(to_cells(df, "row_index", ["text"])).first()
    assert e.context == text[10:116] and e.start_pos == 60 and e.text == "a@b.io"


def test_unicode_word_boundary(spark):
    # Python treats é as a word character, so no boundary before the digits
    (kept, _), = spark_kept(spark, ["é12345 and 12345"])
    assert [(k[0], k[4]) for k in kept] == [(11, "zip_code")]
    (kept2, _), = spark_kept(spark, ["é12345 and 12345"], VeilConfig(unicode_regex=False))
    assert len(kept2) >= 1


def test_custom_patterns(spark):
    reg = PatternRegistry.default().with_patterns([("employee_id", r"\bEMP-\d{6}\b")])
    (kept, masked), = spark_kept(spark, ["Employee EMP-123456 mail j@x.io"], VeilConfig(registry=reg))
    assert [k[4] for k in kept] == ["employee_id", "email_address"]
    assert masked == "Employee [EMPLOYEE_ID_REDACTED] mail [EMAIL_ADDRESS_REDACTED]"


def test_mask_table_keeps_shape(spark):
    df = spark.createDataFrame([
        (0, "John Doe", "john@example.com", "555-123-4567", "Customer since 2020"),
        (1, "Jane", "", None, "call 555-987-6543"),
    ], "row_index long, name string, email string, phone string, notes string")
    out = mask_table(df, "row_index", ["name", "email", "phone", "notes"]).orderBy("row_index").collect()
    assert out[0].email == "[EMAIL_ADDRESS_REDACTED]" and out[0].phone == "[PHONE_NUMBER_REDACTED]"
    assert out[0].name == "John Doe" and out[1].email == "" and out[1].phone is None
    assert out[1].notes == "call [PHONE_NUMBER_REDACTED]"
    assert out[0].notes == "Customer since 2020"


def test_sanitize_formula(spark):
    df = spark.createDataFrame([("=1+1", "+x", "-3"), ("@SUM", "ok", "a=b")], "a string, b string, c string")
    rows = sanitize_formula(df).collect()
    assert [tuple(r) for r in rows] == [("1+1", "x", "3"), ("SUM", "ok", "a=b")]


def test_groups_and_back_references_keep_their_offsets(spark, one_col):
    import random
    import re

    from veilspark.functions.patterns import PatternSpec

    rng = random.Random(4)
    texts = ["xx aaaa yy bbbb"] + ["".join(rng.choice("aab  c1-") for _ in range(40)) for _ in range(60)]
    for regex in (r"(\w)\1{3}", r"(a)(b)?\1", r"([a-c])-?\1", r"(?:1|a(c))b"):
        spec = PatternSpec("x", regex)
        got = one_col(texts).select("text", S.pattern_spans(F.col("text"), spec, 0, unicode=False).alias("s")).collect()
        for r in got:
            assert [(x.start, x.end, x.text) for x in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer(regex, r.text)]
            assert all(r.text[x.start:x.end] == x.text for x in r.s)


def test_patterns_that_match_empty_text_are_refused():
    import pytest

    from veilspark.functions.patterns import PatternSpec

    for regex in ("a*", "x|", r"\b"):
        with pytest.raises(ValueError):
            PatternSpec("x", regex)


def test_very_many_matches_in_one_cell(spark, one_col):
    text = "a1@kiln.test " * 20_000
    spec = PatternRegistry.default().only("email_address").specs[0]
    df = one_col([text]).withColumn("s", S.pattern_spans(F.col("text"), spec, 0))
    kept = df.withColumn("k", S.resolve_overlaps(F.col("s")))
    row = kept.select(F.size("k").alias("n"), S.mask_with_spans(F.col("text"), F.col("k")).alias("m")).first()
    assert row.n == 20_000 and row.m == "[EMAIL_ADDRESS_REDACTED] " * 20_000
