"""Proximity groups and risk scores, including every threshold cell."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import risk as R
from veilspark.operators import analyze as A
from veilspark.operators.cells import to_cells


@pytest.mark.parametrize("base_type,other,level", [
    ("zip_code", "ip_address", "low"),                 # 0.3 + 0.3*0.5 = 0.44999999999999996
    ("zip_code", "location", "medium"),                # 0.3 + 0.6*0.5
    ("zip_code", "physical_address", "high"),          # 0.3 + 0.9*0.5 = 0.75
    ("email_address", "ip_address", "high"),           # 0.5 + 0.15 = 0.65
    ("email_address", "person_name", "high"),          # 0.5 + 0.3 = 0.8
    ("email_address", "phone_number", "critical"),     # 0.5 + 0.45
    ("date_of_birth", "ip_address", "critical"),       # 0.7 + 0.15 = 0.85
    ("credit_card", "ip_address", "critical"),
])
def test_threshold_cells(spark, base_type, other, level):
    df = spark.createDataFrame([(base_type, other)], "a string, b string")
    base = R.base_risk_score(F.col("a"))
    score = R.combined_risk(base, R.pair_risk(F.col("a"), F.col("b")))
    assert df.select(R.score_to_level(score).alias("l")).first().l == level


def test_organization_email_pair_is_medium(spark):
    df = spark.createDataFrame([("organization", "email_address")], "a string, b string")
    assert df.select(R.pair_risk(F.col("a"), F.col("b")).alias("p")).first().p == 0.6


def test_anchor_groups_not_chained(spark):
    # starts 0, 60, 120: 60 joins the group of 0; 120 is 120 from the anchor
    text = "a@b.io" + " " * 54 + "555-123-4567" + " " * 48 + "10.0.0.1"
    df = spark.createDataFrame([(0, text)], "row_index long, text string")
    ent = A.analyze_cells(to_cells(df, "row_index", ["text"])).orderBy("span_ord").collect()
    assert [e.start_pos for e in ent] == [0, 60, 120]
    assert [e.group_ord for e in ent] == [0, 0, 1]
    assert [e.group_size for e in ent] == [2, 2, 1]
    assert ent[0].risk_level == "critical" and ent[0].detection_method == "proximity"
    assert ent[0].related_entities == ["phone_number:555-123-4567..."]
    assert ent[2].risk_level == "low" and ent[2].detection_method == "regex"   # lone ip: base risk


def test_lone_entity_gets_base_risk(spark):
    df = spark.createDataFrame([(0, "SSN 123-45-6789")], "row_index long, text string")
    e = A.analyze_cells(to_cells(df, "row_index", ["text"])).first()
    assert (e.risk_level, e.risk_score, e.group_size) == ("critical", 0.9, 1)
