"""Small tables of several kinds through the end-to-end table job."""

from veilspark.config import VeilConfig
from veilspark.functions.patterns import REGULATIONS, PatternRegistry
from veilspark.operators import report as RP
from veilspark.operators.cells import to_cells, with_row_index
from veilspark.plans.table_job import process_table
from veilspark.sources.tables import ADDRESS_PATTERN

CFG = VeilConfig(registry=PatternRegistry.default().with_patterns([ADDRESS_PATTERN]))


def run(spark, rows, cols):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "row_index long, " + ", ".join(f"{c} string" for c in cols))
    return process_table(df, "row_index", cols, CFG)


def test_clinic_rows(spark):
    res = run(spark, [
        (f"K-{i}", f"Visitor {i}", f"32{i}-54-987{i}", f"{i}/14/197{i}", f"v{i}@clinic.test", "seen") for i in range(1, 5)
    ], ["case_no", "visitor", "ssn", "born", "email", "remark"])
    types = {r.pii_type: r["count"] for r in RP.distribution(res.entities, "pii_type").collect()}
    assert types == {"social_security_number": 4, "date_of_birth": 4, "email_address": 4}
    regs = {r.regulation: r.affected for r in res.regulation_impact().collect()}
    assert regs == {"GDPR": True, "HIPAA": True, "PCI_DSS": False, "CCPA": True}
    assert res.high_risk_entities().count() >= 8


def test_sixteen_digits_look_like_cards(spark):
    res = run(spark, [("Tove Berg", f"{40 + i}11220033004455", f"5{i}00-0000-0000-0004", "left at noon") for i in range(3)],
              ["holder", "ledger_no", "card", "remark"])
    by_col = {}
    for r in res.entities.collect():
        by_col.setdefault(r.column_name, set()).add(r.pii_type)
    assert by_col == {"ledger_no": {"credit_card"}, "card": {"credit_card"}}
    masked = res.masked.orderBy("row_index").first()
    assert masked.card == "[CREDIT_CARD_REDACTED]" and masked.holder == "Tove Berg"


def test_only_the_column_with_personal_data_is_found(spark):
    res = run(spark, [("G1", "blue glaze", "ask mara@kiln.test"), ("G2", "raw clay", "ring 555-0199"),
                      ("G3", "kiln shelf", "tove@kiln.test or shop")], ["item", "what", "ask"])
    assert {r.column_name for r in res.entities.collect()} == {"ask"}
    assert res.entities.count() == 2          # seven digits are no phone number


def test_number_formats(spark):
    res = run(spark, [("(219) 555-0173", "5500-0000-0000-0004", "7 Kiln Street"),
                      ("219.555.0188", "5500-0000-0000-004", "8 Clay Road")], ["phone", "card", "address"])
    ent = {(r.row_index, r.column_name): (r.pii_type, r.text) for r in res.entities.collect()}
    assert ent[(0, "phone")] == ("phone_number", "219) 555-0173")     # \\b before '('
    assert (1, "card") not in ent or ent[(1, "card")][0] != "credit_card"
    assert ent[(0, "address")] == ("physical_address", "7 Kiln Street")


def test_load_1000_rows_and_hostile_strings(spark):
    rows = [(f"u{i}@kiln.test", f"555-{i:04d}", f"Visitor {i}") for i in range(1000)]
    rows += [("'); delete from t where (1=1", "<b onload=x>", "C:\\\\..\\\\x"), ("\x07\x1b", "Q" * 12000, "+1|2")]
    res = run(spark, rows, ["col1", "col2", "col3"])
    assert res.entities.where("column_name = 'col1'").count() == 1000
    assert res.entities.where("column_name = 'col2'").count() == 0
    assert res.masked.count() == 1002


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compliance_document_against_plain_counts(spark):
    res = run(spark, [("a@kiln.test and 321-54-9876", "4111-1111-1111-1111"), ("b@kiln.test", None), ("", "10.0.0.1 c@kiln.test"),
                      ("nothing", "here")], ["x", "y"])
    ent = res.entities.collect()
    doc = res.compliance_document("2024-01-01").first()
    weights = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.1}
    assert doc.timestamp == "2024-01-01" and doc.total_pii_entities == len(ent) > 0
    assert abs(doc.risk_score - 100 * sum(weights[e.risk_level] for e in ent) / len(ent)) < 1e-5
    types = {e.pii_type for e in ent}
    want = [(name, sorted(types & set(under)), sum(e.pii_type in under for e in ent), text)
            for name, under, text in REGULATIONS if types & set(under)]
    assert [tuple(r) for r in doc.affected_regulations] == want
    high = [e.pii_type for e in ent if e.risk_level in ("high", "critical")]
    assert {r.pii_type: r["count"] for r in doc.high_risk_by_type} == {t: high.count(t) for t in high}
    assert doc.recommendations == res.compliance().first().recommendations.split(" | ")


def test_compliance_document_and_profile_of_tables_without_personal_data(spark):
    doc = run(spark, [("nothing", "here")], ["x", "y"]).compliance_document("t").first()
    assert (doc.total_pii_entities, doc.risk_score, doc.affected_regulations, doc.high_risk_by_type) == (0, 0.0, [], [])
    assert len(doc.recommendations) == 2
    cells = to_cells(spark.createDataFrame([], "row_index long, x string"))
    assert RP.column_profile(cells).count() == 0


def test_column_profile_counts_cells_and_scans_once(spark):
    df = spark.createDataFrame([(0, "a@kiln.test b@kiln.test 10.0.0.1", None), (0, "c@kiln.test", "plain"), (1, "", "")],
                               "row_index long, x string, `y.z` string")
    profile = RP.column_profile(to_cells(df))
    assert plan_of(profile).count("Exchange") == 1
    assert sorted(map(tuple, profile.collect())) == [("x", 2, 2, 4, "email_address,ip_address"), ("y.z", 1, 0, 0, "")]


def test_row_index_without_key(spark):
    df = spark.range(0, 1000, numPartitions=7).selectExpr("CAST(id * 3 AS STRING) AS v")
    numbered = with_row_index(df)
    assert "BroadcastHashJoin" in plan_of(numbered) and "Exchange hashpartitioning" not in plan_of(numbered)
    rows = numbered.collect()
    assert sorted((r.row_index, int(r.v)) for r in rows) == [(i, 3 * i) for i in range(1000)]


def test_observed_run_metrics(spark):
    res = run(spark, [("a@b.io 123-45-6789",), ("nothing",)], ["text"])
    observed, obs = RP.observe_run(res.entities)
    observed.write.format("noop").mode("overwrite").save()
    m = obs.get
    assert m["entities"] == 2 and m["high_risk"] == 2 and m["types"] == 2
