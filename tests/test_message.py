"""Message agent: severity, masking and policies against the plain-Python oracle."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

import brute
from veilspark.config import VeilConfig
from veilspark.functions import message as M
from veilspark.functions.patterns import MESSAGE_RULES
from veilspark.streaming.stream import drop_blocked, policy_stream

#: one way to write each kind of personal data, between words that are none
PIECES = ["mara.lind@kiln.test", "o'neil+x@a-b.example.org", "219-55-0173", "(219) 555-0173", "+1 219 555 0173", "2195550173",
          "321-54-9876", "321549876", "5500-0000-0000-0004", "5500000000000004", "10.20.30.40", "api_key=zz91kk20pp33mm44qq55",
          "password: hunter-2", "pwd = x", "45231", "45231-8890", "3/14/1971"]
WORDS = ["kiln", "fired", "at", "cone", "6", "-", "port", "80", "@", "no", "glaze", "12-34", "1.2.3", "ok,", "(x)", "#7"]


def texts(seed, n=250):
    rng = random.Random(seed)
    return [" ".join(rng.choice(PIECES if rng.random() < 0.25 else WORDS) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def column(spark, rows, expr):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    return [r.v for r in df.select("i", expr(F.col("text")).alias("v")).orderBy("i").collect()]


def test_severity_matches_plain_python(spark):
    rows = texts(1) + PIECES + WORDS
    assert column(spark, rows, M.severity) == [brute.severity(t) for t in rows]
    assert {"critical", "sensitive", "contextual", None} <= set(brute.severity(t) for t in rows)
    assert column(spark, ["", None], M.severity) == [None, None]


def test_masking_matches_plain_python(spark):
    rows = texts(2) + PIECES
    assert column(spark, rows, M.mask_message) == [brute.mask_message(t) for t in rows]


def test_masking_is_linear_in_the_rules(spark):
    df = spark.createDataFrame([("x",)], "text string").select(M.mask_message(F.col("text")).alias("m"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert len(re.findall("regexp_replace", plan)) == len(MESSAGE_RULES)


def test_long_texts_are_read_whole(spark):
    long = "x" * 12_000 + " 321-54-9876"
    assert column(spark, [long], M.severity) == ["critical"]
    assert column(spark, [long], lambda t: M.severity(t, oversize="clean")) == [None]
    assert column(spark, [long], lambda t: M.severity(t, oversize="block")) == ["critical"]
    assert column(spark, ["y" * 12_000], lambda t: M.severity(t, oversize="block")) == ["critical"]


POLICY = {
    "log_as_is": lambda t, s: "[WARNING: PII DETECTED] " + t,
    "mask_and_log": lambda t, s: "[BLOCKED] Message contained critical PII" if s == "critical" else brute.mask_message(t),
    "block": lambda t, s: f"[BLOCKED] Message contained {s} PII",
}
STATUS = {"log_as_is": lambda s: "WARNING", "block": lambda s: "BLOCKED",
          "mask_and_log": lambda s: "CRITICAL_BLOCKED" if s == "critical" else "MASKED"}


@pytest.mark.parametrize("policy", POLICY)
def test_policies_and_batch_status(spark, policy):
    rows = texts(3, 80)
    sev = [brute.severity(t) for t in rows]
    assert column(spark, rows, lambda t: M.policy_output(t, M.severity(t), policy)) == [
        t if s is None else POLICY[policy](t, s) for t, s in zip(rows, sev)]
    assert column(spark, rows, lambda t: M.batch_status(M.severity(t), policy)) == [
        "CLEAN" if s is None else STATUS[policy](s) for s in sev]
    assert column(spark, ["", None], lambda t: M.policy_output(t, M.severity(t), policy)) == [None, None]


def test_every_option_reaches_every_form(spark):
    """Whatever an option lets severity detect, masking and dropping cover too."""
    rows = ["schreib an jürgen@grün.example heute", "почта ира@пример.рф", "kein fund", "z" * 11_000 + " 321-54-9876"]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    for unicode in (True, False):
        cfg = VeilConfig(unicode_email_fallback=True, unicode_regex=unicode)
        out = {r.text: r for r in policy_stream(df, cfg=cfg).collect()}
        assert [out[t].severity for t in rows] == ["sensitive", "sensitive", None, "critical"]
        assert not any("@" in (out[t].output or "") or "321-54" in (out[t].output or "") for t in rows)
        assert [r.text for r in drop_blocked(df, cfg=cfg).collect()] == [rows[2]]


def test_hostile_strings_are_fast(spark):
    start = time.time()
    column(spark, ["q" * 3000 + "@", "." * 3000 + "@y", "7" * 3000, "q." * 1500 + "@"], M.severity)
    assert time.time() - start < 10
