"""Cells with many spans: pairs, groups, overlap resolution and snippets against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.config import VeilConfig
from veilspark.functions import risk as R
from veilspark.functions import spans as S
from veilspark.operators import analyze as A
from veilspark.operators import detect as D
from veilspark.operators.cells import to_cells
from veilspark.operators.mask import mask_table
from veilspark.plans.table_job import process_table

SPANS = "array<struct<start:int,end:int,prio:int,text:string,pii_type:string,confidence:double,method:string,ord:int>>"
TYPES = ["email_address", "phone_number", "ip_address", "zip_code"]


def random_cells(seed, n_cells, most, gap):
    rng = random.Random(seed)
    cells = []
    for i in range(n_cells):
        at, spans = rng.randint(0, 5), []
        for k in range(rng.randint(1, most)):
            end = at + rng.randint(1, 4)
            spans.append((at, end, 0, f"t{k}", rng.choice(TYPES), 0.9, "regex", k))
            at = end + rng.randint(0, gap)
        cells.append((i, 0, "c", spans))
    return cells


def frame(spark, cells):
    return spark.createDataFrame(cells, f"row_index long, column_ordinal int, column_name string, spans {SPANS}")


@pytest.mark.parametrize("window", [0, 1, 7, 100])
def test_pairs_and_groups_match_plain_python(spark, window):
    cells = random_cells(window, 60, 40, 30) + [(900, 0, "c", random_cells(5, 1, 3000, 12)[0][3])]
    framed = frame(spark, cells)
    got = {(r.row_index, r.src_ord, r.dst_ord, r.distance) for r in A.proximity_pairs(framed, window=window).collect()}
    want = {(i, a[7], b[7], b[0] - a[0]) for i, _, _, spans in cells for k, a in enumerate(spans) for b in spans[k + 1:k + 102]
            if b[0] - a[0] <= window}
    assert got == want
    groups = framed.select("row_index", R.anchor_groups(F.col("spans"), window).alias("g")).collect()
    spans_of = {c[0]: c[3] for c in cells}
    for row in groups:
        want, anchor = [], None
        for s in spans_of[row.row_index]:
            if anchor is None or s[0] - anchor > window:
                anchor = s[0]
                want.append((anchor, []))
            want[-1][1].append(s[7])
        assert [(g.anchor, [m.ord for m in g.members]) for g in row.g] == want


def plain_mixed(spans):
    kept = []
    for s in sorted(spans, key=lambda x: (x[0], x[2])):
        over = [k for k in kept if s[0] < k[1] and s[1] > k[0]]
        if not over:
            kept.append(s)
        elif s[5] > over[0][5]:
            kept.remove(over[0])
            kept.append(s)
    return sorted(kept, key=lambda x: x[0])


def test_mixed_confidence_matches_plain_python(spark):
    rng = random.Random(3)
    cells = [[]]
    for n in [1, 2, 3, 10, 40, 600, 1500] * 8:
        spans, prio = [], 0
        for _ in range(n):
            start = rng.randint(0, 6 * n)
            prio += 1
            spans.append((start, start + rng.randint(1, 25), prio, "t", rng.choice(TYPES), rng.choice([0.7, 0.8, 0.9]), "regex"))
        cells.append(spans)
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, spans {S.SPAN_ARRAY_TYPE}")
    for row in df.select("i", S.resolve_overlaps(F.col("spans"), mixed_confidence=True).alias("k")).collect():
        assert [tuple(s) for s in row.k] == plain_mixed(cells[row.i])


def test_snippets_of_long_texts(spark):
    rng = random.Random(4)
    text = "".join(rng.choice(["é word ", "😀", "a@b.io ", "x" * 700 + " ", "10.1.2.3 "]) for _ in range(600))
    long_mail = "m" * 3000 + "@example.com"
    for cell in (text, "lead " + long_mail + " tail " * 900, "a@b.io", text[:4096], text[:4097]):
        df = spark.createDataFrame([(0, cell)], "row_index long, text string")
        rows = A.analyze_cells(to_cells(df, "row_index", ["text"])).collect()
        assert rows
        for r in rows:
            assert r.context == cell[max(0, r.start_pos - 50):r.end_pos + 50]
            assert r.text == cell[r.start_pos:r.end_pos]


def test_a_cell_with_very_many_spans(spark):
    n = 8000
    cell = " ".join(f"u{i}@b.io" for i in range(n))
    df = spark.createDataFrame([(0, cell)], "row_index long, text string")
    framed = A.span_frame(to_cells(df, "row_index", ["text"]), VeilConfig())
    ent = A.entities_from_spans(framed)
    sizes = ent.groupBy("group_ord").agg(F.count("*").alias("n"), F.max("group_size").alias("m")).collect()
    assert sum(r.n for r in sizes) == n and all(r.n == r.m for r in sizes)
    starts = [0]
    for i in range(n - 1):
        starts.append(starts[-1] + len(f"u{i}@b.io") + 1)
    far, pairs = 0, 0
    for i in range(n):
        while far + 1 < n and starts[far + 1] - starts[i] <= 100:
            far += 1
        pairs += far - i
    assert A.proximity_pairs(framed, window=100).count() == pairs


def test_column_names_with_dots_blanks_and_backticks(spark):
    names = ["e.mail", "full name", "a`b", "b"]
    df = spark.createDataFrame([(0, "a@b.io", "call 555-222-3333", "x 10.1.2.3", "plain")],
                               "row_index long, c1 string, c2 string, c3 string, c4 string").toDF("row_index", *names)
    res = process_table(df, "row_index", names)
    assert {(r.column_name, r.pii_type) for r in res.entities.collect()} == {
        ("e.mail", "email_address"), ("full name", "phone_number"), ("a`b", "ip_address")}
    assert mask_table(df, "row_index", names).first()[1] == "[EMAIL_ADDRESS_REDACTED]"
    assert res.masked.columns == df.columns
    assert D.entities(to_cells(df, "row_index", names)).count() == 3
