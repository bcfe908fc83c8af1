"""Gazetteer detector, NER label map and pluggable detectors."""

from pyspark.sql import functions as F

from veilspark.config import VeilConfig
from veilspark.operators import detect as D
from veilspark.operators import gazetteer as GZ
from veilspark.operators.cells import to_cells


def _cells(spark):
    df = spark.createDataFrame([
        (0, "Customer#000000001", "NATION_3", "BUILDING", "Meet Jane Roe at MIDDLE EAST office"),
        (1, "Alice", "NATION_10", "AUTOMOBILE", "nothing here"),
    ], "row_index long, full_name string, country string, segment string, notes string")
    return to_cells(df, "row_index", ["full_name", "country", "segment", "notes"])


def _gaz(spark):
    return spark.createDataFrame([
        ("NATION_3", "GPE"), ("NATION_10", "GPE"), ("MIDDLE EAST", "LOC"), ("Customer#000000001", "PERSON"),
        ("Jane Roe", "PERSON"), ("BUILDING", "NORP"), ("AUTOMOBILE", "NORP"), ("Alice", "PERSON"),
    ], "phrase string, label string")


def test_matches_and_label_map(spark):
    cells = _cells(spark)
    raw = {(r.row_index, r.column_name, r.phrase, r.label) for r in GZ.gazetteer_matches(cells, _gaz(spark)).collect()}
    assert (0, "notes", "MIDDLE EAST", "LOC") in raw and (0, "notes", "Jane Roe", "PERSON") in raw
    assert (0, "segment", "BUILDING", "NORP") in raw
    mapped = {(r.row_index, r.column_name, r.text, r.pii_type)
              for r in GZ.gazetteer_spans(cells, _gaz(spark)).collect()}
    assert (0, "segment", "BUILDING", "NORP") not in {(a, b, c, "NORP") for a, b, c, _ in mapped}
    assert (0, "country", "NATION_3", "location") in mapped
    assert (0, "notes", "MIDDLE EAST", "location") in mapped
    assert (1, "full_name", "Alice", "person_name") in mapped


def test_regex_beats_overlapping_gazetteer_span(spark):
    cells = _cells(spark)
    ent = D.entities_with_detectors(cells, [lambda c: GZ.gazetteer_spans(c, _gaz(spark))], VeilConfig())
    got = {(r.row_index, r.column_name, r.pii_type, r.text, r.detection_method) for r in ent.collect()}
    # the 9-digit suffix is an SSN (0.9) and replaces the overlapping person span (0.8)
    assert (0, "full_name", "social_security_number", "000000001", "regex") in got
    assert not any(t == "person_name" and c == "full_name" and r == 0 for r, c, t, _x, _m in got)
    assert (0, "notes", "person_name", "Jane Roe", "ner") in got
    assert (1, "full_name", "person_name", "Alice", "ner") in got


def test_custom_detector_function(spark):
    cells = _cells(spark)

    def office_detector(c):   # any DataFrame -> spans function plugs in
        pos = F.instr("cell_text", "office") - 1
        return c.where(pos >= 0).select("row_index", "column_ordinal", pos.alias("start"),
                                        (pos + 6).alias("end"), F.lit("office").alias("text"),
                                        F.lit("physical_address").alias("pii_type"))

    ent = D.entities_with_detectors(cells, [office_detector], VeilConfig())
    assert {(r.text, r.pii_type) for r in ent.where("column_name = 'notes'").collect()} == {
        ("office", "physical_address")}


def test_phrases_of_any_length_and_case(spark):
    cells = to_cells(spark.createDataFrame([(0, "we sent acme corp to the United Arab Emirates via Paris")],
                                           "row_index long, notes string"), "row_index", ["notes"])
    gaz = spark.createDataFrame([("United Arab Emirates", "GPE"), ("acme corp", "ORG"), ("Paris", "GPE")],
                                "phrase string, label string")
    assert {r.phrase for r in GZ.gazetteer_matches(cells, gaz).collect()} == {"United Arab Emirates", "acme corp", "Paris"}
    assert {r.phrase for r in GZ.gazetteer_matches(cells, gaz, capitalised=True).collect()} == {"United Arab Emirates", "Paris"}


def test_only_hits_become_rows(spark):
    words = " ".join(f"w{i}" for i in range(3000))
    cells = to_cells(spark.createDataFrame([(i, f"{words} New York City {words} York") for i in range(5)], "row_index long, notes string"),
                     "row_index", ["notes"])
    gaz = spark.createDataFrame([("New York", "GPE"), ("New York City", "GPE"), ("York", "GPE"), ("...", "GPE")], "phrase string, label string")
    grams = GZ.ngrams(cells, gaz)
    hits = GZ.gazetteer_matches(cells, gaz)
    assert hits.count() == 5 * 4 and hits.count() <= grams.count() <= 5 * 30      # of 30,000 tokens
    longest = GZ.gazetteer_spans(cells, gaz, longest=True).where("row_index = 0").collect()
    assert sorted(r.text for r in longest) == ["New York City", "York", "York"]
    empty = spark.createDataFrame([], "phrase string, label string")
    assert GZ.gazetteer_matches(cells, empty).count() == 0


def _outputs(plan):
    """Data types that the operators of a plan hand on."""
    found, out, children = [], plan.output(), plan.children()
    for i in range(out.size()):
        found.append(out.apply(i).dataType().simpleString())
    for i in range(children.size()):
        found += _outputs(children.apply(i))
    return found


def test_filter_is_not_a_column(spark):
    """The filter grows with the gazetteer: as a column it was copied into the row of every cell."""
    grams = GZ.ngrams(_cells(spark), _gaz(spark))
    assert "array<bigint>" not in _outputs(grams._jdf.queryExecution().optimizedPlan())
    assert grams.count() >= 7


def test_ngrams_keep_the_text_between_tokens(spark):
    text = "\U0001F600 (Jane--Roe),  Jane Roe; \u00c9mile  Zola."
    cells = to_cells(spark.createDataFrame([(0, text), (None, "Jane Roe")], "row_index long, notes string"), "row_index", ["notes"])
    gaz = spark.createDataFrame([("Jane--Roe", "PERSON"), ("Jane Roe", "PERSON"), ("\u00c9mile  Zola", "PERSON"), ("Roe),  Jane", "ORG")],
                                "phrase string, label string")
    got = {(r.row_index, r.phrase, r.start, r.end) for r in GZ.gazetteer_matches(cells, gaz).collect()}
    assert got == {(0, p, text.index(p), text.index(p) + len(p)) for p, in gaz.select("phrase").collect()} | {(None, "Jane Roe", 0, 8)}
